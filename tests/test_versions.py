import json
from dataclasses import replace

import pytest

from lodestack.functions.text import window_passages
from lodestack.operators import lexical, versions
from lodestack.plans.config import IndexConfig, SearchRequest
from lodestack.plans.index import CorruptIndex, GenerationConflict, Index, Snapshot
from lodestack.sources import extract as EX
from lodestack.sources import ingest
from lodestack.streaming.ingest import apply_requests, ingest_batch, stream_ingest

OPS = "op string, id string, url string, title string, body string, metadata string, updated_at_unix_ms long, vectors array<array<float>>"
MIB = 1 << 20
X = [1.0] + [0.0]
Y = X[::-1]


def ops(spark, *rows):
    full = [(op, i, "", t, b, json.dumps(m), 0, v) if op == "upsert" else (op, i, "", "", None, "{}", 0, None) for op, i, t, b, m, v in rows]
    return spark.createDataFrame(full, OPS)


def up(i, title, body, meta=None, vectors=None):
    return ("upsert", i, title, body, meta or {}, vectors)


def gone(i):
    return ("delete", i, None, None, None, None)


def ids(df):
    return [r.id for r in df.collect()]


def test_updates_deletes_and_compaction(spark, tmp_path):
    ix = Index.create(spark, str(tmp_path / "ix"), IndexConfig())
    ask = lambda q: ids(ix.search(SearchRequest(q, mode="lexical").check(ix.config)))
    assert ask("anything") == []
    r = ix.apply(ops(spark, up("doc-a", "t", "old words"), up("doc-b", "t", "gone soon")))
    assert (r.generation, r.accepted, r.upserts, r.deletes) == (2, 2, 2, 0) and ask("old") == ["doc-a"]
    ix.apply(ops(spark, up("doc-a", "t", "fresh words")))
    assert ask("old") == [] and ask("fresh") == ["doc-a"]
    with pytest.raises(ValueError):
        ix.apply(ops(spark, up("x", "t", "a"), up("x", "t", "b")))
    assert ix.generation() == 3
    ix.apply(ops(spark, gone("doc-b")))
    assert ask("gone") == [] and sorted(r.id for r in ix.events(2).collect()) == ["doc-a", "doc-b"]
    before = ix.documents().count()
    done = ix.compact()
    assert done["removed"] == 3 and ix.documents().count() == before and len(ix.manifest()["segments"]) == 1
    assert ask("fresh") == ["doc-a"] and ix.verify() == [] and ix.status()["state"] == "succeeded"
    assert ix.collect_garbage() == [] and ix.collect_garbage(min_age=0) == []  # older generations are still served
    assert sorted(r.id for r in ix.documents(2).collect()) == ["doc-a", "doc-b"]
    (tmp_path / "ix" / "segment-being-written").mkdir()
    assert ix.collect_garbage(keep=1) == [] and len(ix.collect_garbage(keep=1, min_age=0)) == 4 and ask("fresh") == ["doc-a"]


def test_partial_compaction_keeps_deletions(spark, tmp_path):
    ix = Index.create(spark, str(tmp_path / "ix"), IndexConfig())
    ix.apply(ops(spark, up("big", "t", "word " * 40000), up("doc", "t", "must stay gone")))
    ix.apply(ops(spark, gone("doc")))
    ix.apply(ops(spark, up("new", "t", "newer")))
    sizes = [s["bytes"] for s in ix.manifest()["segments"]]
    assert versions.choose_range(sizes, small=64 * max(sizes[1:]), least=2, budget=sum(sizes[1:])) == (1, 2)
    ix.compact(manual=False, small=64 * max(sizes[1:]), least=2, budget=sum(sizes[1:]))
    assert len(ix.manifest()["segments"]) == 2 and "doc" not in ids(ix.documents())


def test_publish_conflict(spark, tmp_path):
    ix = Index.create(spark, str(tmp_path / "ix"), IndexConfig())
    ix._publish(1, ix.manifest())
    with pytest.raises(GenerationConflict):
        ix._publish(1, ix.manifest())
    with pytest.raises(ValueError):
        Index(spark, ix.folder, IndexConfig(chunk_max_chars=300)).manifest()


def test_hybrid_filter_scope_and_retrieve(spark, tmp_path):
    config = IndexConfig(vectors=True, model_id="m", dimensions=2, filterable_fields=("kind",))
    ix = Index.create(spark, str(tmp_path / "ix"), config)
    ix.apply(ops(spark, up("doc-fruit", "apple guide", "fresh apple", {"kind": "sweet"}, [X]), up("doc-tech", "apple computer", "technology", {"kind": "hard"}, [Y])))
    for mode in ("lexical", "vector", "hybrid"):
        r = SearchRequest("apple", (1.0, 0.0), mode, filter={"eq": dict(field="kind", value="sweet")}, limit=1)
        assert ids(ix.search(r)) == ["doc-fruit"]
        assert [x.document_id for x in ix.search(SearchRequest("apple", (1.0, 0.0), mode, "passages", limit=1)).collect()] == ["doc-fruit"]
    one = ix.retrieve(SearchRequest("technology apple", (0.0, 1.0), limit=5)).first()
    assert one.context == "technology\n\nfresh apple" and one.citations[0].document_id == "doc-tech"
    c = one.citations[1]
    assert (c.title, c.text, c.url, c.start_char, c.end_char, c.context_start, c.context_end) == ("apple guide", "fresh apple", "", 0, 11, 12, 23) and c.lexical_score > 0 and c.fused_score > 0
    assert ix.build_ann()["generation"] == 2 and ix.ann_plan(ix.snapshot())["delta"] == [] and ix.maintain_ann() == "kept"
    ix.apply(ops(spark, up("doc-new", "pear", "fresh pear", {"kind": "sweet"}, [X])))
    for exact in (False, True):
        assert ids(ix.search(SearchRequest(None, (1.0, 0.0), "vector", exact=exact))) == ["doc-fruit", "doc-new", "doc-tech"]
    assert len(ix.ann_plan(ix.snapshot())["delta"]) == 1
    ix.apply(ops(spark, gone("doc-fruit")))
    assert ids(ix.search(SearchRequest(None, (1.0, 0.0), "vector"))) == ["doc-new", "doc-tech"]
    ix.compact()
    assert ix.ann_plan(ix.snapshot())["missing"] == 1 and ids(ix.search(SearchRequest(None, (1.0, 0.0), "vector"))) == ["doc-new", "doc-tech"] and ix.maintain_ann() == "built"
    with pytest.raises(ValueError):
        ix.apply(ops(spark, up("bad", "t", "b", {}, [X, Y])))
    with pytest.raises(ValueError):
        SearchRequest("x", (1.0,), limit=5).check(config)
    first = SearchRequest("apple computer pear", mode="lexical", limit=1)
    answer = ix.response(first)
    assert answer["total"] == 1 and answer["next_cursor"].startswith(f"v1.{ix.generation()}.1.")
    more = ix.response(replace(first, cursor=answer["next_cursor"]))
    assert more["hits"][0]["position"] == 2 and more["hits"][0]["id"] != answer["hits"][0]["id"] and more["next_cursor"] is None
    with pytest.raises(ValueError):
        ix.response(replace(first, query="pear", cursor=answer["next_cursor"]))


def test_choice_of_ranges():
    k = 1024
    assert versions.choose_range([1 * k, 2 * k, 4 * k]) is None and versions.choose_range([1 * k, 2 * k, 4 * k, 8 * k]) == (0, 4)
    assert versions.choose_range([1 * k, 200 * MIB] * 4) is None
    assert versions.choose_range([70 * MIB] * 4) == (0, 4) and versions.choose_range([600 * MIB], manual=True) == (0, 1)
    assert versions.plan_segments([100 * MIB, 20 * MIB, 30 * MIB, 10 * MIB]) == [(0, 4)]
    assert versions.plan_segments([100 * MIB, 100 * MIB, 300 * MIB]) == [(0, 1), (1, 2), (2, 3)]


def test_parsing(spark):
    lines = [
        '{"operation":"upsert","id":"a","body":"x","metadata":{"z":1,"a":{"y":2,"b":1}}}', '{"operation":"delete","id":"a"}', '{"operation":"delete","id":"a","body":"x"}', '{"operation":"upsert","id":"a","body":"x","more":1}',
        '{"operation":"upsert","id":"a","body":"x","metadata":{"k":1,"k":2}}', '{"operation":"upsert","id":"a","body":"x","vectors":[[1,2],[1]]}', '{"operation":"upsert","id":"a","body":"x","url":"' + "u" * 8193 + '"}', "", "[1]", '{"operation":"upsert","id":1,"body":"x"}', '{"operation":"upsert","id":"a","body":"x","vectors":[[1,2],[3,4]]}',
    ]
    got = ingest.parse_ops(spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "n int, value string")).orderBy("n").collect()
    assert got[0].metadata == '{"a":{"b":1,"y":2},"z":1}' and got[10].vectors == [[1.0, 2.0], [3.0, 4.0]]
    assert [r.error for r in got] == [None, None, "delete_with_fields", "unknown_key", "invalid_json", "invalid_vectors", "out_of_range", "invalid_json", "invalid_json", "invalid_field", None]
    tsv = spark.createDataFrame([("https://e.test/\tADD\tTitle\t4\tBody",), ("a\tADD\tT\t5\tBody",), ("a\tDELETE\t\t0\t",), ("a\tADD",)], "value string")
    t = ingest.parse_tsv(tsv).collect()
    assert (t[0].id, t[0].url, t[0].body) == ("https://e.test/", "https://e.test/", "Body") and [r.error for r in t] == [None, "body_length", None, "invalid_columns"]
    batches = spark.createDataFrame([(json.dumps(dict(operations=[dict(id=x, operation="delete") for x in "ab"])),), ('{"operations":[]}',), ('{"x":1}',)], "value string")
    assert [(r.pos, r.id, r.error) for r in ingest.parse_ops(ingest.parse_batch(batches)).orderBy("pos", "id").collect()] == [(-1, None, "invalid_json")] * 2 + [(0, "a", None), (1, "b", None)]
    buffers = spark.createDataFrame([(1, '{"a":1}\r\n\n{"b":2}\n'), (2, "x\n" * 10001), (3, "")], "n int, value string")
    assert [(r.n, r.line, r.error) for r in ingest.split_lines(buffers).orderBy("n", "line").collect()] == [(1, 1, None), (1, 2, "empty_line"), (1, 3, None), (2, 0, "too_many_lines"), (3, 1, "empty_line")]


def test_embedding_provider():
    calls, naps = [], []

    def transport(texts):
        calls.append(list(texts))
        return (503, []) if len(calls) == 1 else (200, [{"index": i, "embedding": [float(len(t))]} for i, t in reversed(list(enumerate(texts)))])

    assert list(ingest.embed_texts(["a", "bb", "ccc"], transport, 2, sleep=naps.append, delay=0.007)) == [[1.0], [2.0], [3.0]]
    assert len(calls) == 3 and naps == [0.007]
    with pytest.raises(ingest.EmbeddingError):
        list(ingest.embed_texts(["a"], lambda t: (400, [])))


def test_extractors():
    html = "<html><title>T</title><style>x</style><h2>Head</h2><ul><li>one<li>two</ul><script>bad()</script><p>a  b</p></html>"
    assert EX.html_text(html) == "T\n## Head\n- one\n- two\na b"
    assert EX.extract_one("a.json", b'{"b":1,"a":2}')[0].startswith('{\n  "a"') and EX.extract_one("x.xml", b"<!DOCTYPE a><a/>")[1]
    assert EX.extract_one("n.bin", b"\0\1")[0] is None and EX.extract_one("t.txt", b"\xef\xbb\xbfa\r\nb") == ("a\nb", None)


def line(op, i, **more):
    return json.dumps(dict(id=i, operation=op, **more))


def test_stream_is_idempotent_and_the_last_arrival_wins(spark, tmp_path):
    ix = Index.create(spark, str(tmp_path / "ix"), IndexConfig())
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("\n".join([line("upsert", "a", body="one"), "broken", line("upsert", "b", body="two"), line("upsert", "c", body="three", updated_at_unix_ms=9), line("delete", "c"), line("delete", "d"), line("upsert", "d", body="back")]))
    run = lambda **o: stream_ingest(spark.readStream.schema("value string").text(str(tmp_path / "in")), ix, str(tmp_path / "cp"), **o).awaitTermination()
    run(failures=str(tmp_path / "bad"))
    assert sorted(ids(ix.documents())) == ["a", "b", "d"]  # c was deleted after it came, d came back
    (bad,) = spark.read.json(str(tmp_path / "bad")).collect()
    assert bad.value == "broken" and bad.error == "invalid_json"
    (tmp_path / "in" / "b.txt").write_text(line("delete", "a"))
    run(failures=str(tmp_path / "bad"))
    g = ix.generation()
    assert sorted(ids(ix.documents())) == ["b", "d"]
    ix.apply(ops(spark, gone("b")), batch_id=1)  # the last batch again
    assert ix.generation() == g
    with pytest.raises(ValueError):
        ingest_batch(ix, spark.createDataFrame([("broken", 1), (line("delete", "b"), 2)], "value string, seq long"), 7)
    assert ix.generation() == g


def test_requests_are_grouped_and_failed_groups_retried_singly(spark, tmp_path):
    assert versions.group_requests([(1, ["a"]), (2, ["b", "c"]), (3, ["a"]), (4, ["d", "e", "f"])], 4) == [[1, 2], [3, 4]]
    got = versions.microbatches(spark.createDataFrame([(t, r, ["x"] if r % 2 else ["y", "z"]) for t in range(2) for r in range(6)], "trigger long, request long, ids array<string>"), 3).collect()
    assert sorted((r.trigger, r.request, r.batch) for r in got) == [(t, r, r // 2) for t in range(2) for r in range(6)]
    ix = Index.create(spark, str(tmp_path / "ix"), IndexConfig())
    rows = [(1, *up("a", "t", "one")), (2, *up("b", "t", "two")), (3, *up("b", "t", "again")), (4, *up("c", "t", "x")), (4, *up("c", "t", "y"))]
    whole = spark.createDataFrame([(r, op, i, "", t, b, "{}", 0) for r, op, i, t, b, *_ in rows], "request long, " + OPS.rsplit(",", 1)[0])
    done = apply_requests(ix, whole)
    assert done[1] == done[2] == 2 and done[3] == 3 and "twice" in done[4]
    assert sorted((r.id, r.body) for r in ix.documents().collect()) == [("a", "one"), ("b", "again")]


def test_lost_writers(spark, tmp_path):
    class Lost(Exception):
        pass

    def lose():
        raise Lost

    for point, want in (("staged", ["a"]), ("written", ["a"]), ("logged", ["a", "b"]), ("published", ["a", "b"])):
        folder = str(tmp_path / point)
        Index.create(spark, folder, IndexConfig()).apply(ops(spark, up("a", "t", "first")))
        with pytest.raises(Lost):
            Index(spark, folder, IndexConfig(), {point: lose}).apply(ops(spark, up("b", "t", "second")))
        ix = Index(spark, folder, IndexConfig())
        ix.recover()
        assert sorted(ids(ix.documents())) == want, point
        assert ix.apply(ops(spark, up("c", "t", "third"))).generation == len(want) + 2 and ix.files.names(f"{folder}/_wal") == []
    (tmp_path / "staged" / "_lock").write_text("someone else")
    with pytest.raises(GenerationConflict):
        Index(spark, str(tmp_path / "staged"), IndexConfig()).apply(ops(spark, up("d", "t", "x")))


def test_damage_is_found(spark, tmp_path):
    ix = Index.create(spark, str(tmp_path / "ix"), IndexConfig())
    ix.apply(ops(spark, up("a", "t", "first words"), up("b", "t", "second words")))
    held = ix.snapshot()
    assert ix.verify() == [] and ix.reload(held) == held
    (tmp_path / "ix" / "segment-lost").mkdir()
    assert ix.verify() == ["orphan segment-lost"]
    with pytest.raises(CorruptIndex):
        ix.reload(Snapshot(99, {}))
    file = next((tmp_path / "ix" / held.segments[0]["id"] / "postings-documents").rglob("*.parquet"))
    file.write_bytes(file.read_bytes()[:-20] + bytes(20))
    file.with_name(f".{file.name}.crc").unlink(missing_ok=True)
    assert "isn't what its manifest says" in ix.verify()[0]
    with pytest.raises(CorruptIndex):
        ix.compact()
    assert ix.status()["state"] == "failed"


def test_a_large_batch_becomes_several_segments(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(versions, "slice_count", lambda size: 3)
    monkeypatch.setattr(lexical, "BUCKET_BYTES", 64)
    ix = Index.create(spark, str(tmp_path / "ix"), IndexConfig())
    r = ix.apply(ops(spark, *[up(f"d{i}", "title", f"common word{i} " * 5) for i in range(30)]))
    assert len(r.segment_ids) == 3 and ix.generation() == 2 and ix.snapshot().segments[0]["buckets"] > 1
    assert ids(ix.search(SearchRequest("word7", mode="lexical"))) == ["d7"] and len(ids(ix.search(SearchRequest("common", mode="lexical", limit=50)))) == 30
    assert [p.text for p in ix.passages(document_id="d3").collect()] == [("common word3 " * 5)]
    assert versions.slice_count is not None and ix.verify() == []
    ix.compact(), ix.compact()
    assert len(ids(ix.search(SearchRequest("common", mode="lexical", limit=50)))) == 30


def test_unicode_profile(spark, tmp_path):
    ix = Index.create(spark, str(tmp_path / "ix"), IndexConfig(tokenizer_id="unicode"))
    ix.apply(ops(spark, up("a", "Ｆｏｏ", "Die Straße in 東京"), up("b", "x", "STRASSE")))
    ask = lambda q, **o: sorted(ids(ix.search(SearchRequest(q, mode="lexical", **o))))
    assert ask("straße") == ["a", "b"] and ask("STRASSE") == ["a", "b"] and ask("foo") == ["a"] and ask("die strasse", phrase=True) == ["a"]
    with pytest.raises(ValueError):
        IndexConfig(tokenizer_id="klingon")


def test_ranking_fixtures_through_the_index(spark, tmp_path):
    ix = Index.create(spark, str(tmp_path / "fx2"), IndexConfig(tokenizer_id="unicode"))
    ix.apply(ops(spark, up("doc-0", "quick brown fox", "search engine"), up("doc-1", "quick fox brown", "search"), up("doc-2", "", "brown archive")))
    ask = lambda q, **o: ids(ix.search(SearchRequest(q, mode="lexical", **o)))
    assert len(ask("quick archive")) == 3 and len(ask("quick brown", operator="and")) == 2 and ask("quick brown", phrase=True) == ["doc-0"]
    assert ix._known(ix.snapshot())["documents"] == {"n": 3, "tokens_title": 6, "tokens_body": 5}
    big = Index.create(spark, str(tmp_path / "fx3"), IndexConfig())
    big.apply(ops(spark, *[up(f"doc-{i:03}", "rare rare rare" if i == 259 else "", "common") for i in range(260)]))
    assert ids(big.search(SearchRequest("common rare", mode="lexical", limit=1))) == ["doc-259"]


def test_windows_cover_texts(spark):
    df = spark.createDataFrame([("x" * n,) for n in (0, 1, 400, 401, 1100)], "t string")
    for r in df.select("t", window_passages(df["t"]).alias("p")).collect():
        assert r.p[0].start_char == 0 and r.p[-1].end_char == len(r.t) and all(len(x.text) == x.end_char - x.start_char for x in r.p)


def test_build_and_command_line(spark, tmp_path, capsys):
    from lodestack.cli import main

    good = [json.dumps(dict(id=f"d{i}", body=f"common words {i}", title="t", operation="upsert")) for i in range(5)]
    (tmp_path / "ok.ndjson").write_text("\n".join(good))
    (tmp_path / "del.ndjson").write_text(json.dumps(dict(id="d1", operation="delete")))
    at = ["--index", str(tmp_path / "ix")]
    with pytest.raises(ValueError):
        main(["build", str(tmp_path / "del.ndjson"), *at], spark)
    assert not (tmp_path / "ix").exists()
    assert main(["build", str(tmp_path / "ok.ndjson"), *at], spark) == 0 and main(["update", str(tmp_path / "del.ndjson"), *at], spark) == 0
    capsys.readouterr()
    assert main(["search", "common", *at, "--limit", "2"], spark) == 0
    answer = json.loads(capsys.readouterr().out)
    assert [h["id"] for h in answer["hits"]] == ["d0", "d2"] and answer["next_cursor"]
    assert main(["search", "common", *at, "--limit", "2", "--cursor", answer["next_cursor"]], spark) == 0
    assert [h["id"] for h in json.loads(capsys.readouterr().out)["hits"]] == ["d3", "d4"]
    assert main(["retrieve", "common", *at, "--limit", "1"], spark) == 0
    assert json.loads(capsys.readouterr().out)["context"] == "common words 0"
    assert main(["compact", *at], spark) == 0 and main(["verify", *at], spark) == 0 and main(["maintain", *at], spark) == 0
    with pytest.raises(ValueError, match="line.: 3"):
        Index.build(spark, str(tmp_path / "no"), IndexConfig(), spark.createDataFrame([(2, good[0]), (3, "{}"), (4, "[")], "line int, value string"))


def test_physical_statistics_return_after_compaction(spark, tmp_path):
    ix = Index.create(spark, str(tmp_path / "ix"), IndexConfig())
    ix.apply(ops(spark, up("a", "t", "red words"), up("b", "t", "blue words")))
    ix.apply(ops(spark, up("a", "t", "red things")))
    score = lambda scope: ix.search(SearchRequest("red", mode="lexical", stats_scope=scope)).first().lexical_score
    assert score("physical") != score("visible")
    ix.compact()
    assert score("physical") == score("visible")
