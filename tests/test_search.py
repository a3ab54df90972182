import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestack.functions.filters import compile_filter, metadata_map
from lodestack.functions.scoring import bm25, vector_score
from lodestack.operators import ann, fusion, lexical, quality, vector


@pytest.fixture(scope="module")
def foxes(spark):
    rows = [("doc-0", "quick brown fox", "search engine"), ("doc-1", "quick fox brown", "search"), ("doc-2", "", "brown archive")]
    return spark.createDataFrame(rows, "id string, title string, body string").cache()


AREA = ["title", "body"]


def test_or_and_phrase(foxes):
    assert lexical.score(foxes, ["quick", "archive"], AREA).count() == 3
    assert lexical.score(foxes, ["quick", "brown"], AREA, operator="and").count() == 2
    assert [r.id for r in lexical.score(foxes, ["quick", "brown"], AREA, phrase=["quick", "brown"]).collect()] == ["doc-0"]
    assert lexical.corpus_stats(foxes, AREA).first()[:] == (3, 6, 5)
    assert lexical.score(foxes, [], AREA).count() == 0 and lexical.score(foxes, ["nothing"], AREA).count() == 0


def test_split_invariance(spark, foxes):
    split = foxes.where("id = 'doc-0'").unionByName(foxes.where("id <> 'doc-0'")).repartition(3)
    assert sorted(map(tuple, lexical.score(split, ["brown", "search"], AREA).collect())) == sorted(map(tuple, lexical.score(foxes, ["brown", "search"], AREA).collect()))


def test_bm25_guards_and_formula(spark):
    row = lambda *a: spark.range(1).select(bm25(*[F.lit(float(x)) for x in a]).alias("s")).first().s
    want = math.log1p((10 - 2 + 0.5) / 2.5) * 3 * 2.2 / (3 + 1.2 * (0.25 + 0.75 * 8 / 4))
    assert abs(row(3, 2, 10, 8, 4) - want) < 1e-12
    assert row(0, 2, 10, 8, 4) == row(3, 0, 10, 8, 4) == row(3, 11, 10, 8, 4) == 0
    assert row(3, 2, 10, 8, 0) == row(3, 2, 10, 8, 1)


def test_posting_counts(spark):
    docs = spark.createDataFrame([("doc-1", "Search Search", "Modern retrieval engine"), ("doc-2", "SEARCH", "vector retrieval")], "id string, title string, body string")
    occ = lexical.occurrences(docs, AREA)
    post = lexical.postings(occ, AREA, positions=True)
    assert occ.count() == 8 and post.count() == 7 and lexical.posting_violations(post, AREA).count() == 0
    assert [r.pos_title for r in post.where("term = 'search' and id = 'doc-1'").collect()] == [[0, 1]]


def test_vector_scores(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [-1.0, 0.0]), (3, [0.0, 0.0])], "vec_id long, embedding array<float>")
    q = spark.range(1).select(vector.literal([1, 0]).alias("q"))
    get = lambda m: [r.score for r in df.crossJoin(q).orderBy("vec_id").select(vector_score(m, F.col("q"), F.col("embedding")).alias("score")).collect()]
    assert get("dot") == [1, 0, -1, 0] and get("cosine") == [1, 0, -1, 0] and get("l2") == [0, -2, -4, -1]
    assert [r.vec_id for r in vector.nearest(df, q, "cosine", 2).collect()] == [0, 1]
    with pytest.raises(ValueError):
        vector_score("none", F.col("q"), F.col("embedding"))


def test_batched_exact_search_and_recall_of_a_fitted_model(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((512, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    q = df.where("vec_id % 13 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("qv"))
    for metric, order in (("cosine", x @ x.T), ("dot", x @ x.T), ("l2", -((x[:, None] - x[None]) ** 2).sum(2))):
        exact = {(r.q, r.vec_id) for r in ann.exact_search(df, q, metric, 10).collect()}
        want = {(i, int(j)) for i in range(0, 512, 13) for j in np.argsort(-order[i], kind="stable")[:10]}
        assert len(exact & want) >= 0.995 * len(want) == 0.995 * len(exact)  # float32 storage may swap near ties
        found = {(r.q, r.vec_id) for r in ann.ann_search(ann.fit(df, metric), df, q, 10).collect()}
        assert len(found & exact) / len(exact) >= 0.95


def test_clustered_vectors_need_few_cells():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((64, 32)).repeat(60, axis=0) + 0.05 * rng.standard_normal((3840, 32))
    model = ann.fit_sample(x, "cosine", 61)
    assert model.probes <= 8 and len(model.centroids) == 61
    again = ann.AnnModel.load(model.dump())
    assert again.probes == model.probes and np.allclose(again.centroids, model.centroids)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_recall_of_the_registered_query(spark, sf):
    from lodestack.plans.catalog import QUERIES

    assert QUERIES["ann_recall"](spark, f"/root/testdata/{sf}").first().recall >= 0.95


def test_blocks_split_hot_cells(spark):
    df = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(300)], "vec_id long, embedding array<float>").withColumn("cell", F.lit(0))
    q = spark.createDataFrame([(i, [float(i), 1.0], [0]) for i in range(40)], "q long, qv array<float>, cells array<int>")
    whole = ann.block_search(df, q, "dot", 5).orderBy("q", "rank").collect()
    assert ann.block_search(df, q, "dot", 5, block=16).orderBy("q", "rank").collect() == whole and len(whole) == 200
    assert [r.vec_id for r in whole[:5]] == [0, 1, 2, 3, 4]  # q = (0, 1): all alike, ties by id


def test_stored_index_reads_only_its_terms(spark, foxes, tmp_path):
    index = lexical.build_index(foxes, AREA, str(tmp_path / "ix"))
    for terms, op, phrase in ((["quick", "archive"], "or", None), (["quick", "brown"], "and", None), (["quick", "brown"], "or", ["quick", "brown"]), (["nothing"], "or", None), ([], "or", None)):
        key = lambda df: sorted(map(tuple, df.select("id", "score", "matched").collect()))
        assert key(index.score(terms, op, phrase)) == key(lexical.score(foxes, terms, AREA, operator=op, phrase=phrase))
    plan = index.score(["quick", "fox"])._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan ==") :]
    assert "PushedFilters: [In(term, [fox,quick])" in physical.replace("quick,fox", "fox,quick") and "PartitionFilters" in physical
    assert "body" not in physical.replace("tf_body", "").replace("len_body", "").replace("pos_body", "") and "pos_title" not in physical  # no text, no positions
    many = lexical.build_index(foxes, AREA, str(tmp_path / "many"))
    assert many.stats == {"n": 3, "tokens_title": 6, "tokens_body": 5}
    lexical.write_postings(foxes, AREA, str(tmp_path / "b8"), 8)
    split = lexical.LexicalIndex(spark, ((str(tmp_path / "b8"), 8),), index.schema, index.fields, index.stats)
    assert sorted(map(tuple, split.score(["quick", "fox", "search"]).collect())) == sorted(map(tuple, index.score(["quick", "fox", "search"]).collect()))
    assert [lexical.bucket_count(n << 20) for n in (0, 1, 64, 65, 200, 1 << 30)] == [1, 1, 1, 2, 4, 4096]


def test_rrf_order_and_checks(spark):
    lex = spark.createDataFrame([("lexical-only", 8.0), ("shared", 7.0)], "id string, score double")
    vec = spark.createDataFrame([("vector-only", 0.95), ("shared", 0.90)], "id string, score double")
    got = fusion.rrf(lex, vec).orderBy("position").collect()
    assert [r.id for r in got] == ["shared", "lexical-only", "vector-only"] and abs(got[0].fused_score - 2 / 62) < 1e-9
    for bad in ({"w_lex": 0.0, "w_vec": 0.0}, {"w_lex": -1.0}, {"w_vec": math.inf}, {"k": 0}):
        with pytest.raises(ValueError):
            fusion.rrf(lex, vec, **bad)


def test_context_fold(spark):
    rows = [(1, "p-first", "doc-a", "first"), (2, "p-second", "doc-a", "second"), (3, "p-third", "doc-b", "third"), (4, "p-third", "doc-b", "third")]
    hits = spark.createDataFrame(rows, "rank int, passage_id string, document_id string, text string")
    one = fusion.context_fold(hits, 10, 1, 64).first()
    assert one.context == "first\n\nthird" and one.used_bytes == 12 and [c.start for c in one.citations] == [0, 7]
    assert fusion.context_fold(hits.where("rank > 1"), 10, 2, 6).first().context == "second"
    empty = fusion.context_fold(hits.where("rank > 9")).first()
    assert empty.context == "" and empty.citations == []


def test_cursors():
    digest = fusion.request_digest({"query": "x", "limit": 10})
    c = fusion.encode_cursor(4, digest, 20)
    assert fusion.decode_cursor(c, 4, digest) == 20
    for bad in (c[:-1], c.replace(".20.", ".30."), "v1.x"):
        with pytest.raises(ValueError):
            fusion.decode_cursor(bad, 4, digest)


FIELDS = ["author.name", "lang", "year"]


def eq(field, value):
    return {"eq": dict(field=field, value=value)}


def test_filters(spark):
    rows = [("a", '{"author":{"name":"Ada"},"lang":"ja","year":2024}'), ("b", '{"author":{"name":"Bob"},"lang":["en","ja"],"year":2019}'), ("c", "{}"), ("d", '{"lang":[],"year":null,"author":{}}')]
    df = spark.createDataFrame(rows, "id string, metadata string").withColumn("meta", metadata_map(F.col("metadata"), FIELDS))
    run = lambda node: [r.id for r in df.where(compile_filter(node, FIELDS)).orderBy("id").collect()]
    assert df.where("id < 'd'").select(F.explode("meta")).select(F.explode("value")).count() == 7
    assert run({"and": [eq("lang", "ja"), {"range": dict(field="year", gte=2020)}]}) == ["a"]
    assert run({"in": {"field": "lang", "values": ["en", 1]}}) == ["b"] and run(eq("author.name", "Bob")) == ["b"]
    assert run({"exists": {"field": "lang"}}) == ["a", "b"] and run(eq("year", None)) == ["d"]
    assert run({"not": eq("lang", "ja")}) == ["c", "d"] and run(eq("year", "2024")) == []
    deep = {"exists": {"field": "lang"}}
    for _ in range(40):
        deep = {"not": deep}
    for bad in (deep, {"eq": {"field": "nope", "value": 1}}, {"and": []}, {"range": {"field": "year"}}, {"range": {"field": "year", "gt": True}}, {"eq": {"field": "lang"}}, {"x": 1}, {}, {"in": {"field": "lang", "values": []}}, {"eq": {"field": "lang", "value": [1]}}):
        with pytest.raises(ValueError):
            compile_filter(bad, FIELDS)


def test_ranking_quality(spark):
    j = spark.createDataFrame([("q", "best", 3), ("q", "good", 2), ("q", "irrelevant", 0)], "query_id string, doc_id string, relevance int")
    run = lambda ids: quality.ranking_quality(spark.createDataFrame([("q", x, i + 1) for i, x in enumerate(ids)], "query_id string, doc_id string, rank int"), j, 10).first()
    r = run(["good", "best", "irrelevant"])
    assert 0.83 < r.ndcg < 0.84 and r.mrr == 1 and r.recall == 1
    assert run(["good", "good"]).recall == 0.5 and run(["none", "good"]).mrr == 0.5


def test_objects_are_inverted_without_a_shuffle(spark, tmp_path, monkeypatch):
    rows = [(i, "the quick\tfox" if i % 3 else None, f"brown {'the ' * (i % 4)}état w{i} fox") for i in range(40)] + [(41, "", ""), (42, None, None)]
    docs = spark.createDataFrame(rows, "id long, title string, body string").repartition(3)
    monkeypatch.setattr(lexical, "INVERT", 7)  # many chunks a batch
    key = lambda df: sorted(map(str, df.select("term", "id", *[f"{c}_{f}" for f in AREA for c in ("tf", "len", "pos")]).collect()))
    for objects in (docs, docs.withColumn("id", F.expr("id div 2"))):  # ids that repeat are merged
        want = key(lexical.postings(lexical.occurrences(objects, AREA), AREA, positions=True))
        assert key(lexical.object_postings(objects, AREA)) == want
        index = lexical.build_index(objects, AREA, str(tmp_path / f"ix{len(want)}"))
        assert key(index.postings()) == want
    plan = lexical.object_postings(docs, AREA, unique=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == docs._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1  # that of the source


def test_batches_of_queries_are_scored_in_blocks(spark, tmp_path, monkeypatch):
    rows = [(i, f"the t{i % 5}", f"{'the ' * (i % 3)}fox w{i % 7} of t{i % 4} z{i % 11}") for i in range(150)]
    docs = spark.createDataFrame(rows, "id long, title string, body string")
    queries = spark.createDataFrame([(q, f"the fox w{q % 7} t{q % 5} none z{q}") for q in range(30)] + [(30, "nothing"), (31, None)], "query_id long, query string")
    index = lexical.build_index(docs, AREA, str(tmp_path / "ix"))
    key = lambda df: sorted((r.query_id, r["rank"], r.id, r.score) for r in df.collect())
    many = key(index.score_many(queries, 4))
    for q in (0, 13, 29):
        one = [(r.id, r.score) for r in lexical.top(index.score(["the", "fox", f"w{q % 7}", f"t{q % 5}", "none", f"z{q}"]), 4).collect()]
        assert [(i, x) for n, _, i, x in many if n == q] == one
    for name, size in (("QUERY_BLOCK", 8), ("POSTING_BLOCK", 50), ("MATRIX", 64), ("AT_ONCE", 3)):
        monkeypatch.setattr(lexical, name, size)
    found = index.score_many(queries, 4)
    assert key(found) == many and {q for q, *_ in many} == set(range(30))
    assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().executedPlan().toString()


def test_scores_are_held_in_tiles(spark, monkeypatch):
    rng = np.random.default_rng(11)
    x = rng.standard_normal((3000, 8))
    model = ann.AnnModel("cosine", rng.standard_normal((500, 8)), 40)
    near, many = model.cells(x), model.cells(x, 40)
    seen = []
    scores = ann._scores
    monkeypatch.setattr(ann, "_scores", lambda m, q, v: seen.append(len(q) * len(v)) or scores(m, q, v))
    monkeypatch.setattr(ann, "SCORES", 1 << 14)
    assert (model.cells(x) == near).all() and (model.cells(x, 40) == many).all() and max(seen) <= 1 << 14
    df = spark.createDataFrame([(i, [float(v) for v in x[i // 3]]) for i in range(600)], "vec_id long, embedding array<float>")
    q = df.where("vec_id % 25 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("qv"))
    got = {}
    for r in ann.exact_search(df, q, "cosine", 10).collect():  # copies tie, so some are cut by key
        got.setdefault(r.q, []).append((-r.score, r.vec_id))
    e = np.array([x[i // 3] for i in range(600)], np.float32).astype(np.float64)
    s = np.round((e @ e.T) / np.outer(np.linalg.norm(e, axis=1), np.linalg.norm(e, axis=1)), 6)
    assert len(got) == 24 and all([v for _, v in sorted(got[i])] == np.lexsort((np.arange(600), -s[i]))[:10].tolist() for i in got)
