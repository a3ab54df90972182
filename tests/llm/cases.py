"""Documents with nulls, empty and long texts, ties, repeated rows and clashing extra columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _spans long, _size long, _new string"


def rows(n: int = 60, seed: int = 7):
    rng = random.Random(seed)
    vocab = ["alpha", "Beta", "gamma", "delta", "épsilon", "zeta", "eta", "théta", "iota", "kappa", "x\U0001f600y", "Mu"]
    out = [
        (0, None, "en", "s0", None, 1, 2, "a"),
        (1, "", "en", "s0", 0, 1, 2, "a"),
        (2, " \t\n\x0b ", "de", None, 5, 1, 2, "a"),
        (None, "null id text with some words in it", None, "s1", 3, 1, 2, "a"),
        (3, "one two", None, "s1", 7, None, None, None),
        (4, "word " * 30000, "fr", "s2", 150000, 1, 2, "a"),
        (5, "a b c d e a b c d e a b c d e f g h", "en", "s0", 3, 1, 2, "a"),
        (6, "same line\nsame line\nother\n\n \nsame line", "en", "s0", 3, 1, 2, "a"),
    ]
    for i in range(7, 7 + n):
        t = " ".join(rng.choice(vocab) + rng.choice(["", ",", ".\n", "#", "\t"]) for _ in range(rng.randint(1, 200)))
        out.append((i, t, rng.choice(["en", "de", None]), rng.choice(["s0", "s1", "s2", None]), len(t), i, 0, "z"))
    out.append(out[-1])  # a repeated row
    out.append((7, "another text under a used id", "en", "s0", 1, 1, 1, "b"))
    return out


def frame(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)


def stored(spark, path, data=None):
    frame(spark, data).write.mode("overwrite").parquet(str(path))
    return spark.read.parquet(str(path))
