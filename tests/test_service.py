import bz2
import gzip
import hashlib
import json
import os
import shutil
import subprocess
import sys

import pytest

from lodestack.functions.text import fnv_passage_id
from lodestack.plans.config import IndexConfig
from lodestack.plans.index import Index
from lodestack.plans.service import Admission, Meter, Overloaded, authorised, handle, request_of
from lodestack.sources import extract as EX
from lodestack.sources import ingest


def test_admission_and_tokens():
    a = Admission(1, 10)
    with a.admit(10):
        with pytest.raises(Overloaded):
            with a.admit(1):
                pass
    with pytest.raises(Overloaded):
        with a.admit(11):
            pass
    assert authorised("Bearer s3", "s3") and not authorised("Bearer s4", "s3") and not authorised(None, "s3") and not authorised("Basic s3", "s3")


def test_requests_are_strict():
    assert request_of({"query": "x", "mode": "lexical"}).limit == 10
    for bad in ({"q": 1}, {"query": 5}, {"limit": "3"}, {"query": "x", "max_context_bytes": 3}, []):
        with pytest.raises(ValueError):
            request_of(bad)


def test_handle(spark, tmp_path):
    lines = [json.dumps(dict(id="a", body="plain words", operation="upsert"))]
    ix = Index.build(spark, str(tmp_path / "ix"), IndexConfig(), spark.createDataFrame([(x,) for x in lines], "value string"))
    assert handle(ix, "search", {"query": "words", "mode": "lexical"})[1]["total"] == 1
    assert handle(ix, "retrieve", {"query": "words", "mode": "lexical"})[1]["context"] == "plain words"
    assert handle(ix, "search", {"mode": "nope"})[0] == 400 and handle(ix, "x", {})[0] == 404 and handle(ix, "live", {})[0] == 200


def test_all_routes_and_metrics(spark, tmp_path):
    ix, meter = Index.create(spark, str(tmp_path / "ix"), IndexConfig()), Meter()
    ask = lambda route, body: handle(ix, route, body, meter, Admission(1, 10_000))
    status, done = ask("documents:batch", {"operations": [dict(operation="upsert", id=x, body=f"words of {x}") for x in "abc"]})
    assert status == 200 and (done["generation"], done["accepted"], done["upserts"]) == (2, 3, 3)
    assert ask("documents:batch", {"operations": []})[0] == 400 and "unknown_key" in ask("documents:batch", {"operations": [dict(operation="upsert", id="x", body="b", more=1)]})[1]["detail"]
    first = ask("search", {"query": "words", "mode": "lexical", "limit": 2})[1]
    second = ask("search", {"query": "words", "mode": "lexical", "limit": 2, "cursor": first["next_cursor"]})[1]
    assert [h["id"] for h in first["hits"] + second["hits"]] == ["a", "b", "c"] and second["next_cursor"] is None
    assert ask("search", {"query": "other", "mode": "lexical", "limit": 2, "cursor": first["next_cursor"]})[0] == 400
    (p,) = ask("passages:prepare", {"id": "d", "body": "One sentence."})[1]["passages"]
    assert p["text"] == "one sentence." and p["passage_id"] == fnv_passage_id("d", 0, p["text"]) and ask("passages:prepare", {"id": ""})[0] == 400
    (c,) = ask("retrieve", {"query": "b", "mode": "lexical", "limit": 1})[1]["citations"]
    assert c["document_id"] == "b" and c["context_end"] == len("words of b")
    text = ask("metrics", {})[1]["text"]
    assert 'lodestack_requests{op="search",status="2xx"} 2' in text and 'lodestack_requests{op="search",status="4xx"} 1' in text and "lodestack_segments 1" in text and 'le="+Inf"} 3' in text
    assert handle(ix, "search", {"query": "x" * 99, "mode": "lexical"}, admission=Admission(1, 10))[0] == 503


def test_no_path_of_the_driver_s_is_needed(tmp_path):
    """The package alone, from another working directory, with workers that can't import it by themselves; and all queries but the optional ones."""
    script = (
        "import sys; sys.path.insert(0, sys.argv[1])\n"
        "from pyspark.sql import SparkSession\n"
        "spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '2').getOrCreate()\n"
        "from lodestack.plans.config import IndexConfig, SearchRequest\n"
        "from lodestack.plans.index import Index\n"
        "from lodestack.sources.ingest import parse_ops\n"
        "ix = Index.create(spark, 'ix', IndexConfig())\n"
        "ix.apply(parse_ops(spark.createDataFrame([('{\"id\":\"a\",\"body\":\"some words\",\"operation\":\"upsert\"}',)], 'value string')))\n"
        "assert [r.id for r in ix.search(SearchRequest('words', mode='lexical')).collect()] == ['a']\n"
    )
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    environment = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", script, repo], cwd=tmp_path, env=environment, capture_output=True, text=True, timeout=240)
    assert done.returncode == 0, done.stderr[-2000:]


def test_the_optional_subpackage_may_be_gone(tmp_path):
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(repo, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and not any(n.startswith('op1_') or n == 'pipeline' for n in q) and set(e.oracle_sql()) <= set(q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]


def test_convert_isolates_failures(spark, tmp_path):
    files = spark.createDataFrame([("a.txt", b"x" * 25), ("b.bin", b"?"), ("c.json", b"{")], "path string, content binary")
    m = {r.kind: (r.documents, r.bytes) for r in EX.convert(files, str(tmp_path / "out"), "c", 10).collect()}
    assert m == {"documents": (3, 25), "failures": (2, 0)} and spark.read.json(str(tmp_path / "out" / "failures")).count() == 2


def test_embeddings_resume(spark, tmp_path):
    p = spark.createDataFrame([(str(i), "t" * i) for i in range(20)], "passage_id string, text string")

    def transport(texts):
        return 200, [{"index": i, "embedding": [float(len(t))]} for i, t in enumerate(texts)]

    def broken(texts):
        raise AssertionError("finished shards aren't embedded again")

    at = str(tmp_path / "e")
    assert ingest.embed_resumable(p, at, "m1", transport, 3).count() == 20
    assert {r.passage_id: r.embedding for r in ingest.embed_resumable(p, at, "m1", broken, 3).collect()}["7"] == [7.0]
    for passages, settings in ((p, "m2"), (p.where("passage_id <> '3'"), "m1")):
        with pytest.raises(ValueError):
            ingest.embed_resumable(passages, at, settings, transport, 3)


def test_shards_rotate_by_bytes_and_lines(spark, tmp_path):
    rows = spark.createDataFrame([(i, "é" * (i % 50)) for i in range(200)] + [(999, "x" * 5000)], "id long, body string").repartition(3)
    m = EX.write_shards(rows, str(tmp_path / "s"), per_file=40, max_bytes=2000).collect()
    assert sum(r.documents for r in m) == 201 and len(m) > 8
    for r in m:
        raw = open(r.path, "rb").read()
        assert (len(raw), raw.count(b"\n"), hashlib.sha256(raw).hexdigest()) == (r.bytes, r.documents, r.sha256) and r.documents <= 40 and (r.bytes <= 2000 or r.documents == 1)
    assert spark.read.json(str(tmp_path / "s")).count() == 201


def test_wiki_dumps(spark, tmp_path):
    page = lambda i, t: json.dumps(dict(id=i, revid=1, url="http://w/" + i, title=" T ", text=t))
    (tmp_path / "a.jsonl.bz2").write_bytes(bz2.compress("\n".join([page("100", "first "), page("101", "  "), page("100", "again")]).encode()))
    (tmp_path / "b.jsonl.gz").write_bytes(gzip.compress("\n".join([page("100", "late"), page("102", "other")]).encode()))
    assert sorted((r.id, r.title, r.body) for r in EX.wiki_dump(spark, str(tmp_path)).collect()) == [("100", "T", "first"), ("102", "T", "other")]
    assert [r.id for r in EX.wiki_dump(spark, str(tmp_path), 1).collect()] == ["100"]
    paths = spark.createDataFrame([("a/x.txt",), ("b/x.txt",), ("a/y.md",)], "path string")
    assert [r.path for r in EX.select_groups(paths, [["^a/", "^c/"], ["txt$"]]).collect()] == ["a/x.txt"]
