"""python -m quadrille validate | explain | init."""

from __future__ import annotations

import argparse
import json
import os
import sys
from pathlib import Path

from .checks.model import CODES, Schema, adjust
from .checks.queries import QueryChecker
from .checks.shapes import ShapeChecker
from .sinks import findings as sink
from .sources.files import expand, read_config

CONFIG = "quadrille.jsonc"


def load_schema(spark, folder: str) -> Schema:
    """The .rdf, .ttl and .owl files of a folder, by version IRI; files that can't be read are skipped with a warning."""
    from . import terms as T
    from .dataset import QuadDataset
    from .schema_index import SchemaIndex
    from .sources import rdfxml
    from .sources.text import turtle

    graphs = {}
    for path in sorted(p for e in ("rdf", "ttl", "owl") for p in expand(f"*.{e}", folder)):
        try:
            raw = Path(path).read_bytes()
            d: QuadDataset = turtle(spark, raw.decode()) if path.endswith(".ttl") else rdfxml.from_bytes(spark, raw)
            g = d.default_graph()
            found = g.filter(f"p = '{T.OWL}versionIRI'").selectExpr("o.v").orderBy("v").first()
            graphs[found[0] if found else f"file://{path}"] = g
        except ValueError as e:
            print(f"warning: {path}: {e}", file=sys.stderr)
    return Schema.of(SchemaIndex.of(graphs)) if graphs else Schema()


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="quadrille")
    sub = p.add_subparsers(dest="command", required=True)
    v = sub.add_parser("validate", help="check queries (.rq, .sparql, .ru) and shapes (.ttl) against schemas")
    v.add_argument("files", nargs="+")
    v.add_argument("--schema", help="folder of schema files")
    v.add_argument("--format", choices=("text", "json", "code-quality"), default="text")
    v.add_argument("--strictness", choices=("lenient", "normal", "strict"), default=None)
    v.add_argument("--config", default=CONFIG)
    x = sub.add_parser("explain", help="show the algebra of a query")
    x.add_argument("file")
    i = sub.add_parser("init", help="write a configuration file")
    i.add_argument("--config", default=CONFIG)
    args = p.parse_args(argv)
    try:
        if args.command == "init":
            if os.path.exists(args.config):
                print(f"{args.config} is there already", file=sys.stderr)
                return 2
            Path(args.config).write_text("// settings of quadrille\n" + json.dumps({"schema": "schemas", "strictness": "normal", "severities": {}, "prefixes": {}}, indent=2) + "\n")
            return 0
        if args.command == "explain":
            from .plans.algebra import show
            from .plans.parser import parse

            q = parse(Path(args.file).read_text())
            print("\n".join(show(u.where) for u in q) if isinstance(q, list) else show(q))
            return 0
        config = read_config(args.config)
        unknown = set(config.get("severities", {})) - set(CODES)
        if unknown:
            raise ValueError(f"unknown codes: {sorted(unknown)}")
        from pyspark.sql import SparkSession

        folder = args.schema or config.get("schema")
        schema = load_schema(SparkSession.builder.getOrCreate(), folder) if folder else Schema()
        found = {}
        for path in dict.fromkeys(f for pattern in args.files for f in expand(pattern)):
            text = Path(path).read_text()
            fs = ShapeChecker(schema).check(text) if path.endswith(".ttl") else QueryChecker(schema, prefixes=config.get("prefixes")).check(text)
            found[path] = adjust(fs, config.get("severities"), args.strictness or config.get("strictness", "normal"))
        print({"text": sink.text, "json": sink.as_json, "code-quality": sink.code_quality}[args.format](found))
        return sink.exit_code(found)
    except (OSError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
