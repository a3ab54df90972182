import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestack.functions import text as TX


def test_unicode_profile_folds_and_splits():
    assert [w for w, _, _ in TX.word_tokens("Ｆｏｏ Straße don't 2.0")] == ["foo", "strasse", "don't", "2.0"]
    assert TX.query_tokens("QUICK quick brown") == ["quick", "quick", "brown"]


def test_passage_ids_of_known_texts():
    assert TX.fnv_passage_id("doc-1", 0, "索引へ登録する本文です。") == "p-624da837772a06f3"
    assert TX.fnv_passage_id("doc-1", 0, "検索対象となる本文です。") == "p-9a6d14af8d0bd5f4"


def test_sentence_chunks():
    got = list(TX.sentence_chunks("d", "One sentence. Two sentence. Three sentence.", 25, 5))
    assert len(got) >= 2 and all(len(t) <= 25 for *_, t, _ in got)
    assert all(b[1] < a[2] for a, b in zip(got, got[1:])) and [g[0] for g in got] == list(range(len(got)))
    assert got == list(TX.sentence_chunks("d", "One sentence. Two sentence. Three sentence.", 25, 5))
    assert [t for *_, t, _ in TX.sentence_chunks("d", "👍🏽👍🏽", 2, 0)] == ["👍🏽", "👍🏽"]
    blank = list(TX.sentence_chunks("d", "　" * 30 + "\n" + "word " * 4 + "\n" * 30 + "end", 12, 3))
    assert all(t.strip() for *_, t, _ in blank) and [g[0] for g in blank] == list(range(len(blank)))
    assert list(TX.sentence_chunks("d", "", 10, 2)) == []
    with pytest.raises(ValueError):
        list(TX.sentence_chunks("d", "x", 5, 5))


def test_grapheme_snippets():
    t = "前半🙂これは検索結果です。後半"
    assert "検索" in TX.snippet_graphemes(t, ["検索"], 8) and len(TX.snippet_graphemes(t, ["検索"], 8)) == 8
    far = "あ" * 5000 + "検索🙂終端"
    assert {"検索", "終端"} <= {w for w in ("検索", "終端") if w in TX.snippet_graphemes(far, ["検索"], 10)}
    assert TX.snippet_graphemes("", ["x"]) == ""


def test_splits_and_truncation_are_lossless():
    t = "para one\n\npara two is longer\nline\n" * 20 + "é" * 50
    parts = TX.split_text(t, 64)
    assert "".join(parts) == t and all(len(p.encode()) <= 64 for p in parts)
    assert TX.truncate_bytes("éé", 3) == "é" and TX.split_text("", 5) == [""]


def test_columns(spark):
    df = spark.createDataFrame([("Hello World hello",), (None,), ("",)], "t string")
    assert [r.n for r in df.select(F.size(TX.tokens(F.col("t"))).alias("n")).collect()] == [3, 0, 0]
    marked = df.select(TX.highlight(TX.snippet_window(F.col("t"), ["World"], 10), ["World"]).alias("s")).first().s
    assert "<mark>World</mark>" in marked


def _old_places(text, most, overlap):
    """sentence_places() by the graphemes of every text."""
    whole, TX._may_join = TX._may_join, lambda t: True
    try:
        return list(TX.sentence_places(text, most, overlap))
    finally:
        TX._may_join = whole


def test_texts_of_single_code_points_need_no_graphemes():
    rng = np.random.default_rng(2)
    for c in range(0x11000):
        if not 0xD800 <= c < 0xE000 and not TX._may_join(chr(c)):
            assert TX.graphemes(f"a{chr(c)}b{chr(c)}") == [0, 1, 2, 3, 4], hex(c)
    alphabets = ["ab. \n!", "aé。あ\n ?", "a\r\n. ", "é👍🏽 .\n한가"]
    for i in range(400):
        text = "".join(rng.choice(list(alphabets[i % 4]), int(rng.integers(0, 80))))
        for most, overlap in ((12, 3), (5, 0), (7, 6)):
            assert list(TX.sentence_places(text, most, overlap)) == _old_places(text, most, overlap), (text, most, overlap)
    assert not TX._may_join("plain é あ") and TX._may_join("é") and TX._may_join("a\r\n")
    assert TX.fold("ABC z") == "abc z" and all(TX.fold(chr(c)) == chr(c).casefold() for c in range(128))


def test_passages_of_a_batch_are_made_in_parts(spark, monkeypatch):
    keys = [(f"d{i % 7}", i, "é" * (i * 37 % 90) + "x" * (i % 5)) for i in range(100)] + [("big", 3, "y" * 20000)]
    monkeypatch.setattr(TX, "HASHED", 16)
    assert TX.fnv_passage_ids(keys) == [TX.fnv_passage_id(*k) for k in keys] and TX.fnv_passage_ids([]) == []
    parts = TX._parts(pa.array(["a" * 100] * 3 + [None] + ["b" * (3 << 20)] + ["c"] * 1000))
    assert sum(len(p) for p in parts) == 1005 and max(len(p) for p in parts) <= 512 and [len(p) for p in TX._parts(pa.array([], pa.string()))] == [0]
    rows = [(str(i), None if i == 3 else "One sentence. Two é. " * (i % 6)) for i in range(40)]
    df = spark.createDataFrame(rows, "id string, t string").repartition(2)
    want = sorted((i, *c) for i, t in rows for c in TX.sentence_chunks(i, t or "", 30, 5))
    assert sorted(map(tuple, df.select("id", F.inline(TX.sentence_passages(30, 5)("id", "t"))).collect())) == want
    some = df.select("id", F.inline(TX.sentence_passages(30, 5, ("ordinal", "end_char"))("id", "t")))
    assert some.columns == ["id", "ordinal", "end_char"] and sorted(map(tuple, some.collect())) == [(w[0], w[1], w[3]) for w in want]
    assert {r.id: r.n for r in df.select("id", TX.normalize_nfkc("t").alias("n")).collect()} == {i: None if t is None else TX.fold(t) for i, t in rows}
