"""Running queries with a timeout, cancellation and result caps."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from typing import Any

from pyspark import InheritableThread
from pyspark.sql import SparkSession

from .engine import query, update
from .plans import algebra as A
from .plans.parser import SparqlSyntaxError, parse
from .sinks import results
from .sources.files import Store

TIMEOUT = 30.0
POLL = 0.05


class QueryTimeout(TimeoutError):
    pass


class QueryCancelled(RuntimeError):
    pass


def guarded(spark: SparkSession, action: Callable[[], Any], timeout: float = TIMEOUT, cancel: threading.Event | None = None) -> Any:
    """The action's result. Its Spark jobs form a group, which is cancelled on timeout or when ``cancel`` is set."""
    group, done, box = f"query-{uuid.uuid4().hex}", threading.Event(), {}

    def body():
        try:
            spark.sparkContext.setJobGroup(group, "query", interruptOnCancel=True)
            box["value"] = action()
        except BaseException as e:  # noqa: BLE001 - handed to the caller
            box["error"] = e
        finally:
            done.set()

    InheritableThread(target=body, daemon=True).start()
    end = time.monotonic() + timeout
    while not done.wait(POLL):
        stop = QueryCancelled("cancelled") if cancel is not None and cancel.is_set() else QueryTimeout(f"no result in {timeout:g} s") if time.monotonic() > end else None
        if stop:
            # jobs that the group has yet to start must not run on behind the caller's back
            spark.sparkContext._jsc.sc().cancelJobGroupAndFutureJobs(group)
            raise stop
    if "error" in box:
        raise box["error"]
    return box["value"]


@dataclass
class Outcome:
    """``kind``: select, ask, graph; ``text``: SPARQL JSON or Turtle; ``error``: (code, message)."""

    kind: str = ""
    text: str = ""
    stats: results.Stats | None = None
    error: tuple[str, str] | None = None


def run_files(spark: SparkSession, text: str, patterns: Iterable[str], root: str = ".", store: Store | None = None, timeout: float = TIMEOUT, max_rows: int = results.MAX_ROWS, cancel: threading.Event | None = None) -> Outcome:
    """A query over local files. Files are read-only: updates are refused."""
    try:
        parsed = parse(text)
    except SparqlSyntaxError as e:
        return Outcome(error=("SYNTAX", str(e)))
    if not isinstance(parsed, A.Query):
        return Outcome(error=("READ_ONLY", "files can't be updated; name an update endpoint"))
    store = store or Store(spark)

    def action() -> Outcome:
        data = store.union(patterns, root)
        df = query(data, parsed)
        if parsed.form == "ASK":
            return Outcome("ask", results.ask_json(df.first()["ask"]))
        if parsed.form == "SELECT":
            nodes = {c for c, k in df.dtypes if k == "string"} & _node_names(data, parsed)
            body, stats = results.select_json(df, nodes, max_rows)
            return Outcome("select", body, stats)
        body, stats = results.turtle(df, max_rows, data.prefixes)
        return Outcome("graph", body, stats)

    try:
        return guarded(spark, action, timeout, cancel)
    except FileNotFoundError as e:
        return Outcome(error=("FILE_NOT_FOUND", str(e)))
    except QueryTimeout as e:
        return Outcome(error=("TIMEOUT", str(e)))
    except QueryCancelled as e:
        return Outcome(error=("CANCELLED", str(e)))
    except Exception as e:  # noqa: BLE001 - reported to the user
        return Outcome(error=("PARSE" if "Error" in type(e).__name__ or "PythonException" in type(e).__name__ else "INTERNAL", str(e)[:2000]))


def _node_names(data, q: A.Query) -> set[str]:
    """Variables whose values are IRIs or blank nodes."""
    from .plans.compiler import Compiler, Context

    rel = Compiler(data).solutions(q, Context())
    return {n for n, s in rel.slots.items() if s.kind in ("node", "key")}


__all__ = ["Outcome", "QueryCancelled", "QueryTimeout", "guarded", "run_files", "update"]
