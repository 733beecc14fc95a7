"""File patterns, a loader by extension with a cache, and configuration files."""

from __future__ import annotations

import glob
import json
import os
import re
from collections import OrderedDict
from collections.abc import Iterable
from pathlib import Path
from typing import Any

from pyspark.sql import SparkSession

from ..dataset import QuadDataset
from . import rdfxml, text


def expand(pattern: str, root: str = ".") -> list[str]:
    """Files of a pattern with ``* ? [ ] { } **``, sorted; a missing folder gives none; a plain path is itself."""
    alternatives = re.search(r"\{([^{}]*)\}", pattern)
    if alternatives:
        found = [f for x in alternatives[1].split(",") for f in expand(pattern[: alternatives.start()] + x + pattern[alternatives.end() :], root)]
        return sorted(dict.fromkeys(found))
    full = pattern if os.path.isabs(pattern) else os.path.join(root, pattern)
    if not any(c in pattern for c in "*?["):
        return [os.path.normpath(full)]
    return sorted(os.path.normpath(f) for f in glob.glob(full, recursive=True) if os.path.isfile(f))


def resolve_paths(patterns: Iterable[str], root: str = ".") -> list[str]:
    """All files of the patterns in order; one that is matched twice counts once."""
    return list(OrderedDict.fromkeys(f for p in patterns for f in expand(p, root)))


class Store:
    """Datasets of files, kept by (path, time, size), the least recently used dropped."""

    def __init__(self, spark: SparkSession, most: int = 8):
        self.spark, self.most = spark, most
        self.held: OrderedDict[str, tuple[tuple, QuadDataset]] = OrderedDict()

    def load(self, path: str) -> QuadDataset:
        stat = os.stat(path)  # a missing file is an error
        mark = (stat.st_mtime_ns, stat.st_size)
        if path in self.held and self.held[path][0] == mark:
            self.held.move_to_end(path)
            return self.held[path][1]
        suffix = Path(path).suffix.lower()
        if suffix in (".xml", ".rdf", ".owl"):
            d = rdfxml.read_models(self.spark, [path])
        elif suffix in (".nt", ".nq"):
            d = text.read_ntriples(self.spark, path)
        else:
            d = text.read_turtle(self.spark, [path])
        d = QuadDataset(d.quads.persist(), d.prefixes)
        if path in self.held:
            self.held.pop(path)[1].quads.unpersist()
        self.held[path] = (mark, d)
        while len(self.held) > self.most:
            self.held.popitem(last=False)[1][1].quads.unpersist()
        return d

    def union(self, patterns: Iterable[str], root: str = ".") -> QuadDataset:
        """The files as one dataset whose default graph is the union of all their graphs."""
        found = [self.load(p) for p in resolve_paths(patterns, root)]
        if not found:
            return QuadDataset.empty(self.spark)
        return found[0].union(*found[1:]).union_default()


def strip_comments(source: str) -> str:
    """JSON with comments and trailing commas to JSON."""
    source = re.sub(r'("(?:[^"\\]|\\.)*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or "", source, flags=re.DOTALL)
    return re.sub(r'("(?:[^"\\]|\\.)*")|,(?=\s*[}\]])', lambda m: m[1] or "", source)


def read_config(path: str) -> dict[str, Any]:
    """A configuration file; one that is missing is empty."""
    if not os.path.exists(path):
        return {}
    return json.loads(strip_comments(Path(path).read_text()) or "{}")
