import math
import random
from collections import Counter

from lodestack.llm.langid import crc_held_out, features, identify
from tests.llm import cases

WORDS = {"en": "the and with that house tree walking under bridge", "de": "und der das nicht straße schön gehen über brücke", "fr": "le est où élève maison être avec sous garçon"}


def data():
    rng = random.Random(4)
    rows = []
    for i in range(240):
        lang = ["en", "de", "fr"][i % 3]
        text = " ".join(rng.choice(WORDS[lang].split()) for _ in range(rng.randint(3, 60)))
        rows.append((i, text.title() if i % 5 == 0 else text, lang if i % 11 else None, "s", 0, 0, 0, ""))
    extra = [(1000, None, "en"), (1001, "", "de"), (1002, "123 !?\n 456", "fr"), (1003, "the and " * 60000, "en"), (None, "und der das nicht", "de"), (1004, "\U0001f600", None)]
    return rows + [(a, b, c, "s", 0, 0, 0, "") for a, b, c in extra] + [rows[0]]


def test_held_out_accuracy_and_edges(spark, tmp_path):
    rows = data()
    d = cases.stored(spark, tmp_path / "d", rows)
    got = identify(d).collect()
    assert len(got) == len(rows)
    truth = {r[0]: ["en", "de", "fr"][r[0] % 3] for r in rows if r[0] is not None and r[0] < 240}
    by = {r.doc_id: r for r in got}
    assert all(r.held_out == crc_held_out(r.doc_id) for r in got) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert held and sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert [by[i].lang_pred for i in (1000, 1001, 1002, 1004)] == ["und"] * 4 and by[1003].lang_pred == "en" and by[None].lang_pred == "de"
    again = identify(spark.read.parquet(str(tmp_path / "d")).repartition(9)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_labels_of_held_out_rows_are_not_used(spark, tmp_path):
    rows = data()
    lied = [(*r[:2], "xx" if crc_held_out(r[0]) else r[2], *r[3:]) for r in rows]
    a = identify(cases.stored(spark, tmp_path / "a", rows)).collect()
    b = identify(cases.stored(spark, tmp_path / "b", lied)).collect()
    assert sorted(map(str, a)) == sorted(map(str, b))


def test_features_do_not_depend_on_pieces(monkeypatch):
    from lodestack.llm import langid

    text = "Straße und Brücke " * 50
    whole = features(text)
    monkeypatch.setattr(langid, "PIECE", 64)
    assert (features(text) == whole).all()


def test_prediction_is_the_nearest_centroid(spark, tmp_path):
    """The same n-grams, weights and cosines, one pair at a time in plain Python."""
    from lodestack.llm.langid import DIMS, train
    from lodestack.llm.langid import _MUL as M

    rows = [r for r in data() if r[1] is None or len(r[1]) < 1000]
    d = cases.stored(spark, tmp_path / "d", rows)
    model = train(d.select("doc_id", "text", "lang"))
    assert sorted(set(model.langs)) == ["de", "en", "fr"] and len(model.langs) == 12
    got = {(r.doc_id, r.score): r.lang_pred for r in identify(d).collect()}
    for doc, text, *_ in rows[::7]:
        if not text or not any(c.isalpha() for c in text):
            continue
        raw, counts = (" " + text.lower() + " ").encode(), Counter()
        for i in range(len(raw)):
            h = 0
            for n in range(4):
                if i + n < len(raw):
                    h = raw[i] * M[0] % 2**32 if n == 0 else (h * M[3] + (raw[i + n] + 1) * M[n]) % 2**32
                    counts[((h ^ (h >> 15)) * M[1]) % 2**32 >> 20] += 1
        v = [math.log1p(counts[k]) * float(model.idf[k]) for k in range(DIMS)]
        norm = math.sqrt(sum(x * x for x in v))
        cos = [sum(float(a) * b for a, b in zip(c, v)) / norm for c in model.centroids]
        best = max(range(len(cos)), key=lambda k: cos[k])
        (score,) = [s for i, s in got if i == doc][:1]
        assert got[doc, score] == model.langs[best] and abs(score - cos[best]) < 1e-4


def test_repeated_ids_and_long_counts_are_drawn_alike(spark, tmp_path):
    rows = [(7 if i % 2 else i, f"the house {i} and that tree" if i % 3 else f"und das {i} nicht schön", "en" if i % 3 else "de", "s", 0, 0, 0, "") for i in range(600)]
    d = cases.stored(spark, tmp_path / "d", rows)
    a, b = (sorted(map(str, identify(x, sample=20).collect())) for x in (d, spark.read.parquet(str(tmp_path / "d")).repartition(5)))
    assert a == b and features("a" * 200000).max() == 65535


def test_empty_and_unlabelled_tables(spark, tmp_path):
    assert identify(cases.stored(spark, tmp_path / "d", [])).count() == 0
    only = cases.stored(spark, tmp_path / "e", [(1, "some text", None, "s", 0, 0, 0, "")])
    assert [r.lang_pred for r in identify(only).collect()] == ["und"]
