"""Command line: prepare, build, update, verify, search, retrieve, compact, maintain.

    python -m lodestack build --index DIR FILE.ndjson
    python -m lodestack search --index DIR "words to find" --mode lexical --limit 5
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from lodestack.plans.config import IndexConfig, SearchRequest
from lodestack.plans.index import Index
from lodestack.sources.ingest import parse_ops


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="lodestack")
    p.add_argument("command", choices=["prepare", "build", "update", "verify", "search", "retrieve", "compact", "maintain"])
    p.add_argument("what", nargs="?", help="an NDJSON file, or the query")
    p.add_argument("--index", required=True)
    p.add_argument("--config", help="a TOML file; defaults otherwise")
    p.add_argument("--mode", default="lexical")
    p.add_argument("--scope", default="documents")
    p.add_argument("--operator", default="or")
    p.add_argument("--phrase", action="store_true")
    p.add_argument("--vector", help="a JSON array")
    p.add_argument("--filter", help="a JSON filter")
    p.add_argument("--limit", type=int, default=10)
    p.add_argument("--cursor", help="next_cursor of the page before")
    a = p.parse_args(argv)
    spark = spark or SparkSession.builder.appName("lodestack").getOrCreate()
    config = IndexConfig.from_toml(open(a.config).read()) if a.config else IndexConfig()
    if a.command == "build":
        index = Index.build(spark, a.index, config, spark.read.text(a.what))
        print(json.dumps({"generation": index.generation()}))
        return 0
    index = Index(spark, a.index, config)
    if a.command == "prepare":
        ops = parse_ops(spark.read.text(a.what)).where("error is null and op = 'upsert'")
        index.prepare(ops).write.json(f"{a.what}.passages")
    elif a.command == "update":
        r = index.apply(parse_ops(spark.read.text(a.what)))
        print(json.dumps({"generation": r.generation, "accepted": r.accepted, "upserts": r.upserts, "deletes": r.deletes}))
    elif a.command == "verify":
        broken = index.verify()
        print(json.dumps(broken))
        return int(bool(broken))  # the exit status
    elif a.command == "compact":
        print(json.dumps(index.compact()))
    elif a.command == "maintain":
        print(json.dumps(index.maintain()))
    else:
        vector = tuple(json.loads(a.vector)) if a.vector else None
        request = SearchRequest(a.what, vector, a.mode, a.scope, a.operator, a.phrase, json.loads(a.filter) if a.filter else None, a.limit, cursor=a.cursor)
        print(json.dumps(index.response(request) if a.command == "search" else index.retrieve(request).first().asDict(recursive=True), ensure_ascii=False))
    return 0
