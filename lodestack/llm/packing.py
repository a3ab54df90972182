"""Best-fit packing of tokenised documents into sequences by exact-complement hashing.

Only lengths matter for packing, and there are at most ``width`` of them. So tasks tokenise, cut long documents and write one
small row per piece with its running number among the task's pieces of that length; the driver sees a
histogram of at most ``width`` counts and makes a *plan* of patterns, each a multiset of lengths and a
count of sequences; every piece then finds its place from its rank within its length. No piece is ever
compared with another, whatever the corpus.

The plan: for each length from the longest down, the gap it leaves is looked up in hashes of single
lengths, pair sums and triple sums, and combinations that fill the gap exactly are consumed as often as counts allow;
what remains is packed by best-fit decreasing on counts. The plan holds O(width) patterns.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestack.storage import materialize

WIDTH = 1024
END = 2
SPECIAL = "<|endoftext|>"


@functools.lru_cache(maxsize=4)  # a worker's tasks share it
def encoder(json_path: str, ranks_path: str | None = None):
    """text -> uint32 ids, as the tokenizer file gives them without added special tokens.

    Where the same vocabulary is at hand as merge ranks, they are used for texts without the special token's string: the same ids, faster.
    """
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(json_path)
    plain = lambda text: np.asarray(slow.encode(text, add_special_tokens=False).ids, np.uint32)
    if not ranks_path:
        return plain
    import base64

    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    check_same(json_path, ranks)
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return lambda text: plain(text) if SPECIAL in text else fast.encode_to_numpy(text, disallowed_special=())


@functools.cache
def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


def check_same(json_path: str, ranks: dict[bytes, int]) -> None:
    """ValueError unless the tokenizer file is a byte-level BPE without normaliser whose tokens and merges are these ranks."""
    with open(json_path, encoding="utf-8") as f:
        t = json.load(f)
    letters, model, pre = _byte_letters(), t["model"], t.get("pre_tokenizer") or {}
    special = {x["content"] for x in t.get("added_tokens", [])}
    own = {bytes(letters[c] for c in word): k for word, k in model["vocab"].items() if word not in special}
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    made = [own[bytes(letters[c] for c in a + b)] for a, b in pairs]
    simple = model["type"] == "BPE" and t.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
    if not simple or own != {w: k for w, k in ranks.items() if w.decode("utf-8", "replace") not in special} or made != sorted(made):
        raise ValueError("the merge ranks aren't the tokenizer file's")


def cuts(n: int, width: int = WIDTH) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: full ones, after a first that holds the remainder."""
    first = (n - 1) % width + 1
    return [(0, first)] + [(s, width) for s in range(first, n, width)]


def tokenize(docs: DataFrame, json_path: str, ranks_path: str | None = None, width: int = WIDTH, end: int = END, with_ids: bool = False) -> DataFrame:
    """Pieces of every row: doc_id, piece, start, length, ids_crc32, task, nth (among the task's pieces of this length), and on demand ids.

    A null text is empty: its only id is ``end``. Repeated rows give pieces of their own.
    """
    names = "doc_id long, piece int, start long, length int, ids_crc32 long, task int, nth long" + (", ids array<int>" if with_ids else "")

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        encode = encoder(json_path, ranks_path)
        task, seen, tail = TaskContext.get().partitionId(), defaultdict(int), np.array([end], np.uint32)
        columns = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"] + ["ids"] * with_ids
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()] + [pa.list_(pa.int32())] * with_ids
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = np.concatenate([encode(text.as_py() or ""), tail]).astype("<u4")
                for k, (s, n) in enumerate(cuts(len(ids), width)):
                    part = ids[s : s + n]
                    rows.append((doc, k, s, n, zlib.crc32(part.tobytes()), task, seen[n]) + ((part.astype(np.int32),) if with_ids else ()))
                    seen[n] += 1
                if len(rows) >= 2000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], columns)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], columns)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, names)


def plan_patterns(counts: dict[int, int], width: int = WIDTH) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths, number of sequences) that use up counts; each pattern's lengths sum to at most width."""
    have = [0] * (width + 1)
    for n, c in counts.items():
        have[n] += c
    out: list[tuple[tuple[int, ...], int]] = []

    def use(pattern: tuple[int, ...]) -> bool:
        need = defaultdict(int)
        for n in pattern:
            need[n] += 1
        k = min(have[n] // m for n, m in need.items())
        if k:
            for n, m in need.items():
                have[n] -= k * m
            out.append((pattern, k))
        return k > 0

    pairs: dict[int, list[tuple[int, int]]] = {}  # sum -> pairs of lengths that are there, thinned out as counts run dry

    def find_pair(total: int, spare: dict[int, int]) -> tuple[int, int] | None:
        if total not in pairs:
            pairs[total] = [(a, total - a) for a in range(1, total // 2 + 1) if have[a] and have[total - a]]
        found = pairs[total]
        while found and not (have[found[-1][0]] and have[found[-1][1]]):
            found.pop()  # a count never grows again
        for a, b in reversed(found):
            left = lambda n: have[n] - spare.get(n, 0)  # noqa: B023, E731
            if left(a) > 0 and left(b) - (a == b) > 0:
                return a, b
        return None

    for n in range(width, 0, -1):
        while have[n]:
            gap = width - n
            if gap == 0:
                use((n,))
            elif have[gap] - (gap == n) > 0:
                use((n, gap))
            elif gap > 1 and (two := find_pair(gap, {n: 1})):
                use((n, *two))
            else:
                three = None
                for a in range(gap - 2, gap // 3 - 1, -1) if gap > 2 else ():
                    if a > 0 and have[a] - (a == n) > 0 and (two := find_pair(gap - a, {n: 1, a: 1} if a != n else {n: 2})):
                        three = (n, a, *two)
                        break
                if not three or not use(three):
                    break
    # what has no exact complement: best-fit decreasing on counts
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    for n in range(width, 0, -1):
        left = have[n]
        while left:
            gap = next((g for g in range(n, width) if open_[g]), None)
            if gap is None:
                per = width // n
                if left // per:
                    open_[width - per * n].append(((n,) * per, left // per))
                if left % per:
                    open_[width - (left % per) * n].append(((n,) * (left % per), 1))
                left = 0
            else:
                pattern, k = open_[gap].pop()
                m = min(k, left)
                if k > m:
                    open_[gap].append((pattern, k - m))
                open_[gap - n].append((pattern + (n,), m))
                left -= m
    out += [x for group in open_.values() for x in group]
    return out


def slots_of(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """length -> (first ranks ascending, sequence of that rank, place in the sequence)."""
    used, base, out = defaultdict(int), 0, defaultdict(list)
    for pattern, k in patterns:
        at = 0
        for n in pattern:
            out[n].append((used[n], base, at))
            used[n] += k
            at += n
        base += k
    return {n: tuple(np.array(c, np.int64) for c in zip(*rows)) for n, rows in out.items()}


def pack(pieces: DataFrame, width: int = WIDTH) -> DataFrame:
    """pieces (a stored table of ``tokenize``) plus sequence_id and offset; task and nth are dropped."""
    per_task = pieces.groupBy("task", "length").count()
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # at most width rows
    slots = pieces.sparkSession.sparkContext.broadcast(slots_of(plan_patterns(counts, width)))
    before = F.sum("count").over(W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1))
    offsets = per_task.select(F.col("task").alias("_t"), F.col("length").alias("_l"), F.coalesce(before, F.lit(0)).cast("long").alias("_before"))
    ranked = pieces.join(offsets, (F.col("task") == F.col("_t")) & (F.col("length") == F.col("_l"))).withColumn("_rank", F.col("nth") + F.col("_before"))
    kept = [c for c in pieces.columns if c not in ("task", "nth")]

    def place(batches):
        import pyarrow as pa

        for batch in batches:
            length, rank = np.asarray(batch.column("length")), np.asarray(batch.column("_rank"))
            seq, at = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length):
                on = np.flatnonzero(length == n)
                first, base, offset = slots.value[int(n)]
                k = np.searchsorted(first, rank[on], "right") - 1
                seq[on], at[on] = base[k] + rank[on] - first[k], offset[k]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(seq), pa.array(at)], [*kept, "sequence_id", "offset"])

    types = dict(pieces.dtypes)
    return ranked.select(*kept, "_rank").mapInArrow(place, ", ".join(f"`{c}` {types[c]}" for c in kept) + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, json_path: str, ranks_path: str | None = None, width: int = WIDTH, end: int = END, with_ids: bool = False) -> DataFrame:
    """Tokenise docs (doc_id, text) and pack them: one row per piece.

    Null and empty texts are a piece of one id; long texts are cut into pieces of ``width``; repeated rows and rows without a doc_id have pieces
    of their own; pieces of one length are alike, so ties need no order; other columns are ignored. An empty docs gives no rows.
    """
    return pack(materialize(tokenize(docs, json_path, ranks_path, width, end, with_ids), "pieces"), width)
