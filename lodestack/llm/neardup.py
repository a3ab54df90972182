"""Exact set-similarity join of documents by word 5-gram Jaccard with several global token orders.

Texts with equal shingle sets form a *class*; classes are joined, and copies are never expanded into pairs.

1. ``sketch``: per row the set size and a 64-bit set fingerprint (class = fingerprint and size).
2. ``frequency_order``: every token is counted. Counts travel as packed 32-bit keys in hash buckets. What the
   tasks of the next step need is bounded: a bitmap of tokens seen in two or more classes (at most ``MAX_BITS`` bits) and the
   most frequent tokens with the logarithm of their count (at most ``MAX_HEAVY``).
3. ``prefixes``: a global order puts tokens that (by the bitmap) occur once first, then the others, then frequent
   ones by count, and hashes break ties differently in each order. Two sets with Jaccard >= t share a token among the first
   n - ceil(t n) + 1 of *every* order, so a pair is a candidate only if it shares prefix tokens under all orders (and
   passes the size and position filters under each). Tokens known to be unique are not sent. Any order is
   correct if it depends on the token alone, so a full bitmap or a truncated list costs time, not links.
4. ``verify``: sets of candidate classes are recomputed and sent to the tiles (pairs of hash buckets) in which they have a pair; the
   number of buckets follows the measured size, so a tile holds about ``TILE_BYTES``, and tiles of many pairs are split, so it holds
   about ``TILE_PAIRS`` of them. Prefix tokens of more than ``HOT`` classes make no pairs: see ``families``. A tile gives no links, but each class's number of linked rows and a spanning forest: rows in proportion to its classes.
5. ``components``: alternating large-star and small-star steps, each stored.

No group is collected: hot tokens are joined by sort-merge (split by AQE), tiles are bounded, hot classes are one row.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm.shingles import batch_words, mix, shingles, texts_of
from lodestack.storage import materialize, scratch

PERCENT = 90
ORDERS = 2
MAX_BITS = 1 << 28
MAX_HEAVY = 1 << 20
HEAVY = 4
BUCKET_TOKENS = 2_000_000
FLUSH_TOKENS = 4_000_000
COARSE = 12
TILE_BYTES = 16 << 20
TILE_PAIRS = 1_000_000
HOT = 128
BLOCK_BYTES = 4 << 20
BLOCK_CLASSES = 1024
#: Marks of a class whose first hot token is the one at hand, and of those in small groups; no token of the first order has low bits.
_FIRST, _MISC = 1, 2
_SALT = [np.uint64(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def _class_of(s: np.ndarray) -> int:
    """Signed 64-bit fingerprint of a sorted set."""
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def _sets(batches, column: int = 0):
    """(batch, row, set) of every text."""
    for batch in batches:
        for i, words in enumerate(batch_words(*texts_of(batch.column(column)))):
            yield batch, i, shingles(words)


def sketch(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, cid (fingerprint of the shingle set; null if it is empty), _key (the column ``key``, a long) for every row."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            n, c = [], []
            for words in batch_words(*texts_of(batch.column("text"))):
                s = shingles(words)
                n.append(len(s))
                c.append(_class_of(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(c, pa.int64()), batch.column("_key")], ["doc_id", "n_shingles", "cid", "_key"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col(key).cast("long").alias("_key")).mapInArrow(run, "doc_id long, n_shingles long, cid long, _key long")


def _distinct_sets(batches):
    """The sets of a task's texts, each class once."""
    seen = set()
    for _, _, s in _sets(batches):
        if len(s):
            c = _class_of(s)
            if (c, len(s)) not in seen:
                seen.add((c, len(s)))
                yield c, s


def frequency_order(docs: DataFrame, tokens: int) -> tuple[np.ndarray, int, np.ndarray, np.ndarray]:
    """Bitmap of repeated tokens, its number of bits (log2), keys of frequent tokens and the level of each.

    A token's key is the top ``32 + r`` bits of its mix, where 2**r buckets split ``tokens``.
    """
    r = max(4, min(24, math.ceil(math.log2(max(1, tokens) / BUCKET_TOKENS + 1))))
    bits = max(r + 3, min(int(math.log2(MAX_BITS)), math.ceil(math.log2(max(1, tokens) + 1))))

    coarse = min(r, COARSE)
    names = ("bucket", "once", "more", "counts")
    kinds = "bucket int, once binary, more binary, counts binary"

    def rows_of(keys, counts, shift):
        """Sorted keys and their counts as rows per bucket (the key's bits above shift): keys that occur once, the others, their counts."""
        import pyarrow as pa

        schema = pa.schema([("bucket", pa.int32()), *[(c, pa.binary()) for c in names[1:]]])
        bucket = (keys >> np.uint64(shift)).astype(np.int64)
        cut = np.concatenate([np.flatnonzero(np.diff(bucket, prepend=-1)), [len(keys)]])  # only buckets that have tokens here
        rows = []
        for a, b in zip(cut[:-1], cut[1:]):
            k, c = keys[a:b], counts[a:b].astype("<u4")
            k = k.astype("<u4") if shift == 32 else k.astype("<u8")
            one = c == 1
            rows.append({"bucket": int(bucket[a]), "once": k[one].tobytes(), "more": k[~one].tobytes(), "counts": c[~one].tobytes()})
            if len(rows) == 4096:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    def pack(batches):
        held, size = [], 0
        for _, s in _distinct_sets(batches):
            held.append(s)
            size += len(s)
            if size >= FLUSH_TOKENS:
                yield from rows_of(*np.unique(mix(np.concatenate(held)) >> np.uint64(32 - r), return_counts=True), 32 + r - coarse)
                held, size = [], 0
        if held:
            yield from rows_of(*np.unique(mix(np.concatenate(held)) >> np.uint64(32 - r), return_counts=True), 32 + r - coarse)

    def split(batches):
        """Rows of coarse buckets, together, as rows of the final ones."""
        keys, counts, size, now = [], [], 0, None

        def flush():
            k, at = np.unique(np.concatenate(keys), return_inverse=True)
            yield from rows_of(k, np.bincount(at, weights=np.concatenate(counts)).astype(np.int64), 32)

        for batch in batches:
            for bucket, once, more, c in zip(*(batch.column(x).to_pylist() for x in names)):
                if size and (bucket != now or size >= FLUSH_TOKENS):
                    yield from flush()
                    keys, counts, size = [], [], 0
                now, one, many = bucket, np.frombuffer(once, "<u8"), np.frombuffer(more, "<u8")
                keys += [one, many]
                counts += [np.ones(len(one), np.int64), np.frombuffer(c, "<u4").astype(np.int64)]
                size += len(one) + len(many)
        if size:
            yield from flush()

    def count(table):
        import pyarrow as pa

        b = table.column("bucket")[0].as_py()
        once = np.concatenate([np.frombuffer(x.as_py(), "<u4") for x in table.column("once")])
        more = np.concatenate([np.frombuffer(x.as_py(), "<u4") for x in table.column("more")])
        counts = np.concatenate([np.frombuffer(x.as_py(), "<u4") for x in table.column("counts")])
        keys = np.concatenate([once, more])
        weight = np.concatenate([np.ones(len(once), np.int64), counts.astype(np.int64)])
        order = np.argsort(keys, kind="stable")
        keys, weight = keys[order], weight[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        df, keys = np.add.reduceat(weight, first), keys[first]
        width = bits - r  # this bucket's slice of the bitmap
        slice_ = np.zeros(1 << width, bool)
        slice_[(keys[df >= 2] >> np.uint32(32 - width)).astype(np.int64)] = True
        heavy = df >= HEAVY
        full = keys[heavy].astype(np.uint64) | (np.uint64(b) << np.uint64(32))
        return pa.table(
            {"bucket": pa.array([b], pa.int32()), "bits": pa.array([np.packbits(slice_).tobytes()], pa.binary()), "keys": pa.array([full.astype("<u8").tobytes()], pa.binary()), "levels": pa.array([np.log2(df[heavy]).astype(np.uint8).tobytes()], pa.binary())}
        )

    packed = docs.select(F.col("text").cast("string")).mapInArrow(pack, kinds)
    if r > coarse:  # so many buckets that a task's tokens would be spread too thin: two passes, as in a radix sort
        packed = packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(split, kinds)
    counted = materialize(packed.groupBy("bucket").applyInArrow(count, "bucket int, bits binary, keys binary, levels binary"), "token-counts")

    def histogram(batches):
        import pyarrow as pa

        total = np.zeros(64, np.int64)
        for batch in batches:
            for x in batch.column("levels"):
                total += np.bincount(np.frombuffer(x.as_py(), np.uint8), minlength=64)
        yield pa.RecordBatch.from_pydict({"level": np.arange(64), "n": total})

    levels = {r["level"]: r["n"] for r in counted.select("levels").mapInArrow(histogram, "level long, n long").groupBy("level").agg(F.sum("n").alias("n")).collect()}
    least, room = 64, MAX_HEAVY
    while least > 0 and levels.get(least - 1, 0) <= room:  # the whole levels that fit
        least -= 1
        room -= levels.get(least, 0)

    def top(batches):
        import pyarrow as pa

        for batch in batches:
            for k, v in zip(batch.column("keys"), batch.column("levels")):
                v = np.frombuffer(v.as_py(), np.uint8)
                on = v >= least
                yield pa.RecordBatch.from_pydict({"keys": [np.frombuffer(k.as_py(), "<u8")[on].tobytes()], "levels": [v[on].tobytes()]}, schema=pa.schema([("keys", pa.binary()), ("levels", pa.binary())]))

    bitmap = np.zeros((1 << bits) // 8, np.uint8)
    step = (1 << (bits - r)) // 8
    for row in counted.select("bucket", "bits").toLocalIterator():  # MAX_BITS in all
        bitmap[row["bucket"] * step : (row["bucket"] + 1) * step] = np.frombuffer(row["bits"], np.uint8)
    rows = counted.select("keys", "levels").mapInArrow(top, "keys binary, levels binary").collect()  # MAX_HEAVY in all
    keys = np.concatenate([np.frombuffer(x["keys"], "<u8") for x in rows] or [np.empty(0, "<u8")])
    levels_ = np.concatenate([np.frombuffer(x["levels"], np.uint8) for x in rows] or [np.empty(0, np.uint8)])
    order = np.argsort(keys)
    return bitmap, bits, keys[order], levels_[order], r


def prefixes(docs: DataFrame, order, percent: int, orders: int) -> DataFrame:
    """tok (hash under an order, whose number is in the low bits), cid, n, pos: prefix tokens that may have a partner."""
    bitmap, bits, heavy, level, r = order
    shared = docs.sparkSession.sparkContext.broadcast((bitmap, heavy, level))

    def run(batches):
        import pyarrow as pa

        bitmap, heavy, level = shared.value
        names = ["tok", "cid", "n", "pos"]
        out, size = [], 0

        def emit():
            t, c, n, p = (np.concatenate(x) for x in zip(*out))
            return pa.RecordBatch.from_arrays([pa.array(t.view(np.int64)), pa.array(c), pa.array(n), pa.array(p)], names)

        for c, s in _distinct_sets(batches):
            n = len(s)
            m = mix(s)
            at = (m >> np.uint64(64 - bits)).astype(np.int64)
            rank = (bitmap[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1  # 0: occurs once
            if len(heavy):
                key = m >> np.uint64(32 - r)
                where = np.minimum(np.searchsorted(heavy, key), len(heavy) - 1)
                hit = heavy[where] == key
                rank = np.where(hit, level[where] + 1, rank)
            take = n - -(-percent * n // 100) + 1
            for o in range(orders):
                h = mix(s ^ _SALT[o])
                full = (rank.astype(np.uint64) << np.uint64(58)) | (h >> np.uint64(6))
                first = np.argpartition(full, take - 1)[:take] if take < n else np.arange(n)
                first = first[np.argsort(full[first], kind="stable")]
                pos = np.flatnonzero(rank[first] > 0)
                if len(pos):
                    tok = (h[first[pos]] & ~np.uint64(3)) | np.uint64(o)
                    out.append((tok, np.full(len(pos), c, np.int64), np.full(len(pos), n, np.int64), pos.astype(np.int64)))
                    size += len(pos)
            if size >= 200_000:
                yield emit()
                out, size = [], 0
        if out:
            yield emit()

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "tok long, cid long, n long, pos long")


def with_hot(prefix: DataFrame) -> DataFrame:
    """prefix plus ``hot``: whether more than HOT classes have the token."""
    sizes = prefix.groupBy("tok").count().where(F.col("count") > HOT).select("tok", F.lit(True).alias("_hot"))
    return prefix.join(sizes, "tok", "left").select(*prefix.columns, F.coalesce("_hot", F.lit(False)).alias("hot"))


def candidates(prefix: DataFrame, percent: int, orders: int) -> DataFrame:
    """Pairs of classes (c1, n1) < (c2, n2) that share a token of the first order which isn't hot, and pass the filters of all orders. Where both have
    hot tokens under another order they may share one, so that order doesn't tell them apart. prefix (with_hot) is a stored table."""
    cool = prefix.where("not hot")
    a = cool.select("tok", F.col("cid").alias("c1"), F.col("n").alias("n1"), F.col("pos").alias("p1"))
    b = cool.select("tok", F.col("cid").alias("c2"), F.col("n").alias("n2"), F.col("pos").alias("p2"))
    need = f"{percent} * (n1 + n2) <= {100 + percent} * (least(p1, p2) + 1 + least(n1 - p1, n2 - p2) - 1)"
    fits = f"(c1 < c2 or (c1 = c2 and n1 < n2)) and 100 * least(n1, n2) >= {percent} * greatest(n1, n2) and {need}"
    pairs = a.join(b, "tok").where(fits)
    bit = F.bit_or(F.expr("shiftleft(1, cast(tok & 3 as int))"))
    seen = pairs.groupBy("c1", "n1", "c2", "n2").agg(bit.alias("seen")).where("seen & 1 = 1")
    masks = prefix.where("hot").groupBy("cid", "n").agg(bit.alias("mask"))
    for k in (1, 2):
        seen = seen.join(masks.select(F.col("cid").alias(f"c{k}"), F.col("n").alias(f"n{k}"), F.col("mask").alias(f"m{k}")), [f"c{k}", f"n{k}"], "left")
    every = F.col("seen").bitwiseOR(F.coalesce(F.col("m1").bitwiseAND(F.col("m2")), F.lit(0)))
    return seen.where(every == (1 << orders) - 1).select("c1", "n1", "c2", "n2")


def shared_counts(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many tokens each set of a shares with each of b, by matrix products over the tokens that both sides have, some at a time."""
    out = np.zeros((len(a), len(b)), np.float32)
    sides = []
    common = np.intersect1d(np.concatenate(a), np.concatenate(b))
    if not len(common):
        return out.astype(np.int64)
    for sets in (a, b):
        tokens, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.minimum(np.searchsorted(common, tokens), len(common) - 1)
        on = common[at] == tokens
        order = np.argsort(at[on], kind="stable")
        sides.append((at[on][order], row[on][order], len(sets)))
    for low in range(0, len(common), 4096):
        width, grids = min(4096, len(common) - low), []
        for at, row, k in sides:
            i, j = np.searchsorted(at, (low, low + width))
            grid = np.zeros((k, width), np.float32)
            grid[row[i:j], at[i:j] - low] = 1
            grids.append(grid)
        out += grids[0] @ grids[1].T
    return out.astype(np.int64)


def families(docs: DataFrame, prefix: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """What ``verify`` gives, for the linked classes that share hot tokens of the first order and no others; rows in proportion to the blocks, never pairs.

    The classes of a hot token are split into blocks; a tile is two blocks, compared by matrix products of their sets. A pair
    counts at its first hot token only, and not at all if it shares a token that isn't hot. Classes are
    grouped by their first hot token, since two of one group have met there, so the tokens of one family don't repeat its work. prefix (with_hot) and sizes are stored tables.
    """
    lists = prefix.where("tok & 3 = 0").groupBy("cid", "n").agg(F.sort_array(F.collect_list(F.struct("pos", "tok", "hot"))).alias("_l"))  # a class's prefix
    own = lambda hot: F.transform(F.filter("_l", lambda x: x["hot"] == F.lit(hot)), lambda x: x["tok"])
    lists = lists.select("cid", "n", own(True).alias("hots"), own(False).alias("cools")).where(F.size("hots") > 0)
    rows = lists.select("cid", "n", "hots", "cools", F.posexplode("hots").alias("_j", "tok"))
    rows = rows.select("tok", "cid", "n", F.when(F.col("_j") > 0, F.col("hots")[0]).otherwise(_FIRST).alias("f"), F.concat(F.expr("slice(hots, 1, _j)"), "cools").alias("before"))
    rows = materialize(rows, "family-members")
    groups = rows.groupBy("tok", "f").agg(F.count("*").alias("k"), F.sum("n").alias("t"))
    groups = groups.withColumn("g", F.when((F.col("f") == _FIRST) | (F.col("k") >= BLOCK_CLASSES // 4), F.col("f")).otherwise(_MISC))
    pools = groups.groupBy("tok", "g").agg(F.greatest(F.ceil(F.sum("k") / BLOCK_CLASSES), F.ceil(8 * F.sum("t") / BLOCK_BYTES)).cast("int").alias("blocks"))
    groups = materialize(groups.join(pools, ["tok", "g"]).select("tok", "f", "g", "blocks"), "family-groups")
    blocks = groups.select("tok", "g", "blocks").distinct().select("tok", "g", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("k"))
    a, b = (blocks.select("tok", F.col("g").alias(f"g{i}"), F.col("k").alias(f"k{i}")) for i in (1, 2))
    tiles = a.join(b, "tok").where(f"(g1 < g2 or (g1 = g2 and k1 <= k2)) and (g1 <> g2 or g1 in ({_FIRST}, {_MISC}))")
    tiles = materialize(tiles, "family-tiles")
    placed = rows.join(groups, ["tok", "f"]).withColumn("k", F.pmod(F.xxhash64("cid", "n"), F.col("blocks")).cast("int")).select("tok", "g", "k", "cid", "n", "before")
    tile = ["tok", "g1", "k1", "g2", "k2"]
    side = lambda i: placed.withColumnsRenamed({"g": f"g{i}", "k": f"k{i}"}).join(tiles, ["tok", f"g{i}", f"k{i}"]).select(*tile, F.lit(i).alias("side"), "cid", "n", "before")
    members = side(1).unionByName(side(2).where("g1 <> g2 or k1 <> k2"))
    wanted = rows.select("cid", "n").distinct()
    stored = class_sets(docs, wanted).dropDuplicates(["cid", "n"])
    whole = members.join(stored, ["cid", "n"]).join(sizes.select("cid", "n", "class_size"), ["cid", "n"]).select(*tile, "side", "cid", "n", "class_size", "before", "tokens")

    def check(table):
        import pyarrow as pa

        sides = np.asarray(table.column("side").combine_chunks())
        ids = list(zip(table.column("cid").to_pylist(), table.column("n").to_pylist()))
        weight, n = (np.asarray(table.column(c).combine_chunks()).astype(np.int64) for c in ("class_size", "n"))
        tokens = [np.frombuffer(t.as_buffer(), np.uint64) for t in table.column("tokens").combine_chunks()]
        before = [np.asarray(x, np.int64) for x in table.column("before").to_pylist()]
        one = np.flatnonzero(sides == 1)
        same = not (sides == 2).any()  # a block with itself; a tile without its other block has no pairs either way
        two = one if same else np.flatnonzero(sides == 2)
        rows = []
        if len(one) and len(two):
            pick = lambda x, at: [x[i] for i in at]
            both = shared_counts(pick(tokens, one), pick(tokens, two))
            ok = 100 * both >= percent * (n[one][:, None] + n[two][None, :] - both)
            if same:
                ok = np.triu(ok, 1)
            if ok.any():
                ok &= shared_counts(pick(before, one), pick(before, two)) == 0
            linked = np.zeros(len(ids), np.int64)
            linked[one] += (ok * weight[two][None, :]).sum(axis=1)
            linked[two] += (ok * weight[one][:, None]).sum(axis=0)
            label = np.arange(len(ids))
            while True:  # the smallest number that each can reach
                old = label.copy()
                label[one] = np.minimum(label[one], np.where(ok, label[two][None, :], len(ids)).min(axis=1))
                label[two] = np.minimum(label[two], np.where(ok, label[one][:, None], len(ids)).min(axis=0))
                if (old == label).all():
                    break
            rows = [(*ids[i], *ids[label[i]], None) for i in np.flatnonzero(label != np.arange(len(ids)))] + [(*ids[i], None, None, int(linked[i])) for i in np.flatnonzero(linked)]
        return pa.table({name: pa.array([r[i] for r in rows], pa.int64()) for i, name in enumerate(("c1", "n1", "c2", "n2", "linked"))})

    return whole.groupBy(*tile).applyInArrow(check, "c1 long, n1 long, c2 long, n2 long, linked long")


def class_sets(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(cid, n, tokens) of the wanted classes (cid, n), and of a few others, once per task at most: texts are hashed again, and a bounded filter of
    classes keeps the others from being sent."""
    spark = docs.sparkSession
    bits = min(26, max(16, math.ceil(math.log2(max(1, classes.count()))) + 4))
    width = 1 << bits
    bucketed = classes.select(F.shiftrightunsigned("cid", 64 - bits).alias("b")).distinct()

    def marks(batches):
        import pyarrow as pa

        on = np.zeros(width, bool)
        for batch in batches:
            on[np.asarray(batch.column("b"))] = True
        packed = np.packbits(on)
        step = 1 << 13
        for i in range(0, len(packed), step):
            if packed[i : i + step].any():
                yield pa.RecordBatch.from_pydict({"i": [i], "bits": [packed[i : i + step].tobytes()]}, schema=pa.schema([("i", pa.int64()), ("bits", pa.binary())]))

    mask = np.zeros(width // 8, np.uint8)
    for row in bucketed.repartitionByRange(8, "b").mapInArrow(marks, "i long, bits binary").toLocalIterator():
        part = np.frombuffer(row["bits"], np.uint8)
        mask[row["i"] : row["i"] + len(part)] |= part
    wanted = spark.sparkContext.broadcast(mask)

    def sets(batches):
        import pyarrow as pa

        mask = wanted.value
        schema = pa.schema([("cid", pa.int64()), ("n", pa.int64()), ("tokens", pa.binary())])
        rows = []
        for c, s in _distinct_sets(batches):
            i = (c & 0xFFFFFFFFFFFFFFFF) >> (64 - bits)
            if mask[i >> 3] >> (7 - (i & 7)) & 1:
                rows.append({"cid": c, "n": len(s), "tokens": s.tobytes()})
                if len(rows) >= 256:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return docs.select(F.col("text").cast("string")).mapInArrow(sets, "cid long, n long, tokens binary")


def verify(docs: DataFrame, pairs: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """What the pairs whose exact Jaccard is at least percent / 100 come to: rows (c1, n1, c2, n2) of spanning forests, and rows
    (c1, n1, linked) with the rows of classes linked with c1, both in parts to be united and summed. pairs and sizes (cid, n, class_size) are stored tables."""
    classes = pairs.select(F.col("c1").alias("cid"), F.col("n1").alias("n")).unionByName(pairs.select(F.col("c2").alias("cid"), F.col("n2").alias("n"))).distinct()
    total = classes.agg(F.count("*").alias("k"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    if total["k"] == 0:
        return pairs.withColumn("linked", F.lit(None).cast("long"))
    buckets = max(2, math.ceil(2 * 8 * total["n"] / TILE_BYTES))
    bucket = lambda c: F.pmod(c, F.lit(buckets))
    tiled = pairs.withColumn("b1", bucket(F.col("c1"))).withColumn("b2", bucket(F.col("c2")))
    tiled = tiled.withColumn("ti", F.least("b1", "b2")).withColumn("tj", F.greatest("b1", "b2")).drop("b1", "b2")
    held = tiled.groupBy("ti", "tj").agg(F.ceil(F.count("*") / TILE_PAIRS).alias("parts"))
    tiled = tiled.join(held, ["ti", "tj"]).withColumn("part", F.pmod(F.xxhash64("c1", "n1", "c2", "n2"), F.col("parts"))).drop("parts")
    own = lambda k: tiled.select("ti", "tj", "part", F.col(f"c{k}").alias("cid"), F.col(f"n{k}").alias("n"))
    places = own(1).unionByName(own(2)).distinct().join(sizes.select("cid", "n", "class_size"), ["cid", "n"])
    stored = class_sets(docs, classes)
    placed = places.join(stored, ["cid", "n"]).select(F.col("ti").alias("si"), F.col("tj").alias("sj"), F.col("part").alias("sp"), "cid", "n", "class_size", "tokens")

    def check(left, right):
        import pyarrow as pa

        held, weight = {}, {}
        for c, n, w, t in zip(*(right.column(x).to_pylist() for x in ("cid", "n", "class_size")), right.column("tokens")):
            if (c, n) not in held:
                held[c, n], weight[c, n] = np.frombuffer(t.as_buffer(), np.uint64), w
        linked, above, forest = {}, {}, []

        def root(x):
            while (y := above.get(x, x)) != x:
                above[x] = x = above.get(y, y)
            return x

        for c1, n1, c2, n2 in zip(*(left.column(x).to_pylist() for x in ("c1", "n1", "c2", "n2"))):
            a, b = held[c1, n1], held[c2, n2]
            at = np.searchsorted(b, a)
            at[at == len(b)] = 0
            both = int((b[at] == a).sum())
            if 100 * both >= percent * (n1 + n2 - both):
                linked[c1, n1] = linked.get((c1, n1), 0) + weight[c2, n2]
                linked[c2, n2] = linked.get((c2, n2), 0) + weight[c1, n1]
                x, y = root((c1, n1)), root((c2, n2))
                if x != y:
                    above[x] = y
                    forest.append((c1, n1, c2, n2, None))
        rows = forest + [(c, n, None, None, k) for (c, n), k in linked.items()]
        return pa.table({name: pa.array([r[i] for r in rows], pa.int64()) for i, name in enumerate(("c1", "n1", "c2", "n2", "linked"))})

    return tiled.groupBy("ti", "tj", "part").cogroup(placed.groupBy("si", "sj", "sp")).applyInArrow(check, "c1 long, n1 long, c2 long, n2 long, linked long")


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for every vertex of edges (a, b): root is the smallest vertex of its component."""
    e = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v")
        small = small.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        e = materialize(small, "edges")
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            return e.select(F.col("u").alias("v"), F.col("v").alias("root")).unionByName(e.select("v", F.col("v").alias("root")).distinct())
        state = now


def rooted(edges: DataFrame) -> DataFrame:
    """components(), stored."""
    with scratch():
        return materialize(components(edges), "roots", keep=True)


def jaccard_groups(docs: DataFrame, percent: int = PERCENT, orders: int = ORDERS) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, n_similar, component_id, class_size.

    docs is a stored table with doc_id and text. Null and wordless texts have size 0, no links and their own doc_id as component.
    Rows are documents: rows that repeat a doc_id and text are linked with one another. component_id is the smallest
    non-null doc_id of the component. Other columns are ignored.
    """
    return _grouped(docs.select("doc_id", "text"), "doc_id", percent, orders).drop("_key", "root")


def _grouped(d: DataFrame, row: str, percent: int, orders: int) -> DataFrame:
    """jaccard_groups plus ``_key`` (the column ``row``) and ``root``, which names the component; null for a row without links."""
    rows = materialize(sketch(d, row), "sketch")
    key = F.concat_ws(":", "cid", "n")
    classes = rows.where("n_shingles > 0").groupBy("cid", F.col("n_shingles").alias("n")).agg(F.count("*").alias("class_size"), F.min("doc_id").alias("first_id"))
    classes = materialize(classes, "classes")
    tokens = classes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("t")).first()["t"]
    if tokens == 0:
        return rows.select("doc_id", "n_shingles", F.lit(0).cast("long").alias("n_similar"), F.col("doc_id").alias("component_id"), F.lit(1).cast("long").alias("class_size"), "_key", F.lit(None).cast("string").alias("root"))
    with scratch():
        prefix = materialize(prefixes(d, frequency_order(d, tokens), percent, orders).distinct(), "prefixes")
        prefix = materialize(with_hot(prefix), "prefixes")
        pairs = materialize(candidates(prefix, percent, orders), "candidates")
        links = verify(d, pairs, classes, percent)
        if prefix.where("hot and tok & 3 = 0").limit(1).count():
            links = links.unionByName(families(d, prefix, classes, percent))
        links = materialize(links, "links", keep=True)
    degree = links.where("c2 is null").groupBy(F.col("c1").alias("cid"), F.col("n1").alias("n")).agg(F.sum("linked").alias("linked"))
    roots = rooted(links.where("c2 is not null").select(F.concat_ws(":", "c1", "n1").alias("a"), F.concat_ws(":", "c2", "n2").alias("b")))
    found = classes.join(degree, ["cid", "n"], "left").where("class_size > 1 or linked is not null")
    found = found.withColumn("v", key).join(roots, "v", "left").withColumn("root", F.coalesce("root", "v"))
    least = found.groupBy("root").agg(F.min("first_id").alias("component_id"))
    found = found.join(least, "root").select(F.col("cid").alias("_c"), F.col("n").alias("_n"), "class_size", (F.col("class_size") - 1 + F.coalesce("linked", F.lit(0))).alias("n_similar"), "component_id", "root")
    out = rows.join(found, (F.col("cid") == F.col("_c")) & (F.col("n_shingles") == F.col("_n")), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("n_similar", F.lit(0)).cast("long").alias("n_similar"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"), "_key", "root")


def keep_one(docs: DataFrame, percent: int = PERCENT, orders: int = ORDERS) -> DataFrame:
    """docs without near copies: of every group the row with the smallest doc_id stays, one without a doc_id only if none has one.

    Every row is judged by its own text, so different texts under one doc_id both stay; of equal rows the first by row number stays.
    Null, empty and wordless rows are in no group and stay. Texts are compared whole, however long. An empty docs gives no rows.
    """
    keyed = materialize(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.monotonically_increasing_id().alias("_key")), "rows")
    with scratch():
        judged = _grouped(keyed.select("_row.doc_id", "_row.text", "_key"), "_key", percent, orders).select("doc_id", "_key", "root")
        judged = materialize(judged, "judged", keep=True)
    first = judged.where("root is not null").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "_key")).alias("m")).select("m._key")
    stay = judged.where("root is null").select("_key").unionByName(first)
    return keyed.join(stay, "_key", "left_semi").select("_row.*")
