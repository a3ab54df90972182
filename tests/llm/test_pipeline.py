"""The pipeline against brute-force versions of its stages, each on its own input."""

import re

import corpus_pipeline
from lodestack.llm.queries import tokenizer_files
from tests.llm import cases
from tests.llm.test_mixing import brute_targets, words
from tests.llm.test_neardup import data as documents
from tests.llm.test_neardup import kept_rows
from tests.llm.test_quality import LABELS
from tests.llm.test_quality import brute as brute_counts
from tests.llm.test_secrets import SECRETS
from tests.llm.test_secrets import brute as brute_spans


def test_stages(spark, tmp_path):
    filler = " and some more plain words so that it is long enough to stay"
    repeated = [(i, " ".join(f"{w}{k}" for k in range(40)), "en", "s1", 1, 1, 1, "") for i, w in [(1001, "red"), (1001, "blue"), (None, "green"), (None, "green"), (None, "grey"), (1001, "")]]
    rows = documents() + repeated + [(5000 + i, t + filler, "en", "s0", 0, 0, 0, "") for i, t in enumerate(SECRETS)]
    cases.stored(spark, tmp_path / "documents.parquet", rows)
    spark.createDataFrame([(5, 1, 0, "x")], LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.collect()] if name != "packing" else None
        out = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = [tuple(r) for r in docs.collect()]
        kept[name] = after
        if name == "quality":
            assert sorted(map(str, after)) == sorted(str(r) for r in before if not brute_counts(r[1])[5])
        elif name == "near_duplicates":
            assert sorted((str(r[0]), r[1]) for r in after) == sorted((str(r[0]), r[1]) for r in kept_rows(before))
        elif name == "secrets":
            assert sorted(str(r[0]) for r in after) == sorted(str(r[0]) for r in before) and not any(brute_spans(r[1]) for r in after)
            clean = {str(r) for r in before if not re.search("[:=]|AKIA|[0-9a-f]{16}", r[1])}
            assert clean <= set(map(str, after))
        elif name == "mixing":
            sizes = {}
            for r in before:
                sizes[r[3]] = sizes.get(r[3], 0) + words(r[1])
            took = {}
            for r in after:
                took[r[3]] = took.get(r[3], 0) + words(r[1])
            for s, target in brute_targets(sizes).items():
                longest = max(words(r[1]) for r in before if r[3] == s)
                assert abs(took.get(s, 0) - target) <= longest, s
        else:
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(tokenizer_files()[0])
            want = sum(len(tok.encode(r[1], add_special_tokens=False).ids) + 1 for r in kept["mixing"])
            assert sum(r[3] for r in after) == want
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(kept["packing"])


def test_empty_tables(spark, tmp_path):
    cases.stored(spark, tmp_path / "documents.parquet", [])
    spark.createDataFrame([], LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
