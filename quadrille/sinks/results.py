"""Results as SPARQL JSON, Turtle and Markdown, with row caps and a truncation flag."""

from __future__ import annotations

import json
import re
import time
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import terms as T
from ..sources.text import ntriples_line

NATIVE = {"bigint": T.INTEGER, "int": T.INTEGER, "double": T.DOUBLE, "boolean": T.BOOLEAN, "timestamp_ntz": T.DATETIME, "date": T.DATE, "string": T.STRING}
MAX_ROWS = 10_000
DISPLAY_ROWS = 50


@dataclass
class Stats:
    seconds: float
    rows: int
    truncated: bool


def _binding(v: Any, kind: str, iri: bool) -> dict[str, str] | None:
    if v is None:
        return None
    if kind.startswith("struct<k:"):
        if v["k"] == T.IRI_KIND:
            return {"type": "uri", "value": v["v"]}
        if v["k"] == T.BNODE_KIND:
            return {"type": "bnode", "value": v["v"].removeprefix("_:")}
        out = {"type": "literal", "value": v["v"]}
        if v["lang"]:
            out["xml:lang"] = v["lang"]
        elif v["dt"] != T.STRING:
            out["datatype"] = v["dt"]
        return out
    if iri:
        return {"type": "bnode", "value": v[2:]} if v.startswith("_:") else {"type": "uri", "value": v}
    text = str(v).lower() if kind == "boolean" else v.isoformat() if hasattr(v, "isoformat") else str(v)
    dt = T.DECIMAL if kind.startswith("decimal") else NATIVE.get(kind, T.STRING)
    return {"type": "literal", "value": text} | ({} if dt == T.STRING else {"datatype": dt})


def select_json(df: DataFrame, nodes: set[str] = frozenset(), max_rows: int = MAX_ROWS) -> tuple[str, Stats]:
    """SPARQL results JSON of at most ``max_rows`` rows; ``nodes``: string columns that hold IRIs. Unbound variables are left out."""
    start = time.time()
    rows = df.limit(max_rows + 1).collect()
    kinds = dict(df.dtypes)
    shown = [{c: b for c in df.columns if (b := _binding(r[c], kinds[c], c in nodes))} for r in rows[:max_rows]]
    text = json.dumps({"head": {"vars": df.columns}, "results": {"bindings": shown}}, ensure_ascii=False)
    return text, Stats(time.time() - start, len(shown), len(rows) > max_rows)


def ask_json(value: bool) -> str:
    return json.dumps({"head": {}, "boolean": value})


def turtle(df: DataFrame, max_triples: int = MAX_ROWS, prefixes: dict[str, str] | None = None) -> tuple[str, Stats]:
    """Turtle of a graph result. The cap counts triples as they come, before duplicates go."""
    start = time.time()
    rows = df.select("s", "p", "o").limit(max_triples + 1)
    lines = [r[0] for r in rows.select(ntriples_line(rows)).collect()]
    kept = sorted(set(lines[:max_triples]))
    head = [f"@prefix {k}: <{v}> ." for k, v in sorted((prefixes or {}).items())]

    def short(line: str) -> str:
        for k, v in sorted((prefixes or {}).items(), key=lambda x: -len(x[1])):
            line = re.sub(rf"<{re.escape(v)}([A-Za-z_][\w-]*)>", rf"{k}:\1", line)
        return line

    return "\n".join([*head, *map(short, kept)]) + "\n", Stats(time.time() - start, len(kept), len(lines) > max_triples)


def markdown(df: DataFrame, rows: int = DISPLAY_ROWS) -> str:
    """A table of the first rows, and a note where there are more."""
    found = df.limit(rows + 1).collect()
    show = lambda v: "" if v is None else str(v["v"] if hasattr(v, "asDict") else v).replace("|", "\\|").replace("\n", " ")
    out = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    out += ["| " + " | ".join(show(v) for v in r) + " |" for r in found[:rows]]
    if len(found) > rows:
        out.append(f"\n… more than {rows} rows")
    return "\n".join(out)


def json_lines(df: DataFrame, path: str) -> None:
    """Uncapped results, written by the executors."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)
