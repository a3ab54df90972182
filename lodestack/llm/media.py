"""Media columns: ISO base media containers, written and read without decoding payloads.

``write_container`` stores a payload as 8-bit samples of one audio track (``ftyp``, ``mdat``, ``moov`` with full sample tables).
``read_container`` walks the nested boxes of any such file, with any number of tracks, decodes the sample tables (stsd, stts, ctts, stsc, stsz/stz2,
stco/co64, stss) and the runs of movie fragments (trex, tfhd, tfdt, trun), and gives codec, duration and the byte ranges of samples
and keyframes; payload bytes are only sliced. Without stss every sample is a keyframe, as in uncompressed audio.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.storage import materialize

UNIT = 64  # bytes per sample (access unit)
CHUNK = 64  # samples per chunk
RATE = 8000
_CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex", b"moof", b"traf"}
_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 >= 1 << 32:
        return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body
    return struct.pack(">I4s", len(body) + 8, kind) + body


def _full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


def write_container(payload: bytes) -> bytes:
    """A container whose samples are the payload's 64-byte units; the payload is a positive multiple of that."""
    n = len(payload) // UNIT
    ftyp = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2mp41")
    mdat = _box(b"mdat", payload)
    data = len(ftyp) + len(mdat) - len(payload)
    chunks = -(-n // CHUNK)
    offsets = data + np.arange(chunks, dtype=np.int64) * CHUNK * UNIT
    large = int(offsets[-1]) >= 1 << 32
    place = _full(b"co64", struct.pack(">I", chunks), offsets.astype(">u8").tobytes()) if large else _full(b"stco", struct.pack(">I", chunks), offsets.astype(">u4").tobytes())
    last = n - (chunks - 1) * CHUNK
    runs = [(1, CHUNK), (chunks, last)] if chunks > 1 and last != CHUNK else [(1, CHUNK if chunks > 1 else last)]
    entry = _box(b"raw ", struct.pack(">6xH", 1), struct.pack(">HHIHHHHI", 0, 0, 0, 1, 8, 0, 0, RATE << 16))
    ticks = n * UNIT
    stbl = _box(
        b"stbl",
        _full(b"stsd", struct.pack(">I", 1), entry),
        _full(b"stts", struct.pack(">III", 1, n, UNIT)),
        _full(b"stsc", struct.pack(">I", len(runs)), b"".join(struct.pack(">III", a, b, 1) for a, b in runs)),
        _full(b"stsz", struct.pack(">II", UNIT, n)),
        place,
    )
    dref = _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))
    minf = _box(b"minf", _full(b"smhd", struct.pack(">hH", 0, 0)), _box(b"dinf", dref), stbl)
    wide = ticks >= 1 << 32
    times = struct.pack(">QQIQ", 0, 0, RATE, ticks) if wide else struct.pack(">IIII", 0, 0, RATE, ticks)
    mdia = _box(b"mdia", _full(b"mdhd", times, struct.pack(">HH", 0x55C4, 0), version=int(wide)), _full(b"hdlr", struct.pack(">I4s12x", 0, b"soun"), b"text\0"), minf)
    span = struct.pack(">IIIIQ", 0, 0, 1, 0, 0)[:16] + struct.pack(">I", min(ticks, 0xFFFFFFFF))
    tkhd = _full(b"tkhd", span, bytes(8), struct.pack(">hhhH", 0, 0, 0x100, 0), _MATRIX, struct.pack(">II", 0, 0), flags=7)
    mvhd = _full(b"mvhd", times, struct.pack(">IH10x", 0x10000, 0x100), _MATRIX, bytes(24), struct.pack(">I", 2), version=int(wide))
    return ftyp + mdat + _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))


def walk(data: memoryview, start: int = 0, end: int | None = None, depth: int = 0):
    """(path-free) boxes in order: (kind, body start, body end, depth). ValueError where a box leaves its parent."""
    at, end = start, len(data) if end is None else end
    while at < end:
        if end - at < 8:
            raise ValueError("a box head is cut off")
        size, kind = struct.unpack_from(">I4s", data, at)
        body = at + 8
        if size == 1:
            if end - at < 16:
                raise ValueError("a long box head is cut off")
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        elif size == 0:
            size = end - at
        if at + size > end or at + size < body:
            raise ValueError(f"box {kind!r} doesn't fit its parent")
        yield kind, body, at + size, depth
        if kind in _CONTAINERS and depth < 32:
            yield from walk(data, body, at + size, depth + 1)
        at += size


def _table(data: memoryview, body: int, end: int, kind: str, per: int, skip: int = 4) -> np.ndarray:
    (n,) = struct.unpack_from(">I", data, body + skip)
    size = np.dtype(kind).itemsize * per
    if body + skip + 4 + n * size > end:
        raise ValueError("a sample table is longer than its box")
    return np.frombuffer(data, kind, n * per, body + skip + 4).astype(np.int64).reshape(n, per)


def _sizes(data: memoryview, kind: bytes, a: int, b: int) -> np.ndarray:
    """Sample sizes of stsz or stz2 (4, 8 or 16 bits each)."""
    if kind == b"stsz":
        each, n = struct.unpack_from(">II", data, a + 4)
        return np.full(n, each, np.int64) if each else _table(data, a, b, ">u4", 1, 8)[:, 0]
    bits, n = data[a + 7], struct.unpack_from(">I", data, a + 8)[0]
    if bits not in (4, 8, 16) or a + 12 + (n * bits + 7) // 8 > b:
        raise ValueError("a sample table is longer than its box")
    if bits == 4:
        packed = np.frombuffer(data, np.uint8, (n + 1) // 2, a + 12)
        return np.stack([packed >> 4, packed & 15], axis=1).reshape(-1)[:n].astype(np.int64)
    return np.frombuffer(data, ">u2" if bits == 16 else np.uint8, n, a + 12).astype(np.int64)


def _placed(t: dict) -> None:
    """offsets of a track's samples from its chunks."""
    sizes, chunks, runs = t["sizes"], t["chunks"], t["stsc"]
    per = np.zeros(len(chunks), np.int64)
    for i, (first, k, _) in enumerate(runs):
        per[first - 1 : runs[i + 1][0] - 1 if i + 1 < len(runs) else len(chunks)] = k
    if per.sum() < len(sizes):
        raise ValueError("the chunks hold fewer samples than there are")
    chunk_of = np.repeat(np.arange(len(chunks)), per)[: len(sizes)]
    before = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    first = np.searchsorted(chunk_of, np.arange(len(chunks)))
    base = before[np.minimum(first, max(0, len(sizes) - 1))] if len(sizes) else before
    t["offsets"] = chunks[chunk_of] + before - base[chunk_of] if len(sizes) else np.empty(0, np.int64)


def _run(data: memoryview, a: int, b: int, head: dict, at: int) -> tuple[np.ndarray, int]:
    """(offset, size, duration, keyframe) of a fragment run's samples, and where its data ends."""
    flags, n = struct.unpack_from(">I", data, a)[0] & 0xFFFFFF, struct.unpack_from(">I", data, a + 4)[0]
    p = a + 8
    if flags & 1:
        at = head["base"] + struct.unpack_from(">i", data, p)[0]
        p += 4
    first = head["flags"]
    if flags & 4:
        first = struct.unpack_from(">I", data, p)[0]
        p += 4
    fields = [name for bit, name in ((0x100, "duration"), (0x200, "size"), (0x400, "flags"), (0x800, "shift")) if flags & bit]
    if p + 4 * len(fields) * n > b:
        raise ValueError("a run is longer than its box")
    rows = np.frombuffer(data, ">u4", len(fields) * n, p).astype(np.int64).reshape(n, len(fields))
    get = lambda name: rows[:, fields.index(name)] if name in fields else np.full(n, head[name], np.int64)
    size, flag = get("size"), get("flags").copy()
    if n and "flags" not in fields:
        flag[0] = first
    start = at + np.concatenate([[0], np.cumsum(size)])
    return np.stack([start[:-1], size, get("duration"), (flag >> 16 & 1) == 0], axis=1), int(start[-1])


def read_container(media: bytes) -> list[dict]:
    """Tracks: track_id, codec, handler, timescale, duration (ticks), offsets and sizes of samples, keyframes (sample numbers from 0) and
    their byte ranges. ValueError if the boxes or tables are broken, or needed ones are missing."""
    try:
        return _read(memoryview(media))
    except (struct.error, IndexError, KeyError) as e:
        raise ValueError(f"broken container: {type(e).__name__} {e}") from e


def _read(data: memoryview) -> list[dict]:
    tracks, by_id, extends, now, frag, head, at = [], {}, {}, None, 0, None, 0
    for kind, a, b, depth in walk(data):
        if kind == b"trak":
            now = {"runs": [], "track_id": 0, "codec": None, "handler": None, "timescale": 0, "duration": 0}
            tracks.append(now)
        elif kind == b"moof":
            frag = at = a - 8
        elif kind == b"trex":
            track, _, duration, size, flags = struct.unpack_from(">5I", data, a + 4)
            extends[track] = {"duration": duration, "size": size, "flags": flags}
        elif kind == b"tfhd":
            flags, track = struct.unpack_from(">I", data, a)[0] & 0xFFFFFF, struct.unpack_from(">I", data, a + 4)[0]
            head = {"track": track, "base": frag, "duration": 0, "size": 0, "flags": 0} | extends.get(track, {})
            p = a + 8
            for bit, name, form in ((1, "base", ">Q"), (2, None, ">I"), (8, "duration", ">I"), (16, "size", ">I"), (32, "flags", ">I")):
                if flags & bit:
                    if name:
                        head[name] = struct.unpack_from(form, data, p)[0]
                    p += struct.calcsize(form)
            at = head["base"]
        elif kind == b"trun" and head is not None:
            rows, at = _run(data, a, b, head, at)
            if head["track"] in by_id:
                by_id[head["track"]]["runs"].append(rows)
        elif now is not None:
            if kind == b"tkhd":
                now["track_id"] = struct.unpack_from(">I", data, a + (20 if data[a] == 1 else 12))[0]
                by_id[now["track_id"]] = now
            elif kind == b"mdhd":
                now["timescale"], now["duration"] = struct.unpack_from(">IQ", data, a + 20) if data[a] == 1 else struct.unpack_from(">II", data, a + 12)
            elif kind == b"hdlr":
                now["handler"] = bytes(data[a + 8 : a + 12]).decode("latin-1")
            elif kind == b"stsd":
                now["codec"] = bytes(data[a + 12 : a + 16]).decode("latin-1").strip()
            elif kind == b"stts":
                now["stts"] = _table(data, a, b, ">u4", 2)
            elif kind == b"ctts":
                now["ctts"] = _table(data, a, b, ">i4" if data[a] == 1 else ">u4", 2)
            elif kind == b"stsc":
                now["stsc"] = _table(data, a, b, ">u4", 3)
            elif kind == b"stco":
                now["chunks"] = _table(data, a, b, ">u4", 1)[:, 0]
            elif kind == b"co64":
                now["chunks"] = _table(data, a, b, ">u8", 1)[:, 0]
            elif kind == b"stss":
                now["stss"] = _table(data, a, b, ">u4", 1)[:, 0] - 1
            elif kind in (b"stsz", b"stz2"):
                now["sizes"] = _sizes(data, kind, a, b)
    for t in tracks:
        _placed(t)
        t["keyframes"] = t.get("stss", np.arange(len(t["sizes"])))
        for rows in t["runs"]:  # the fragments' samples follow those of the tables
            n = len(t["sizes"])
            t["offsets"], t["sizes"] = np.concatenate([t["offsets"], rows[:, 0]]), np.concatenate([t["sizes"], rows[:, 1]])
            t["keyframes"] = np.concatenate([t["keyframes"], n + np.flatnonzero(rows[:, 3])])
            t["duration"] += int(rows[:, 2].sum()) if n or not t["duration"] else 0
        o, s, k = t["offsets"], t["sizes"], t["keyframes"]
        if len(k) and (k.min() < 0 or k.max() >= len(s)):
            raise ValueError("a keyframe is no sample")
        if len(s) and (int((o + s).max()) > len(data) or int(o.min()) < 0):
            raise ValueError("a sample lies outside the file")
        t["ranges"] = np.stack([o[k], o[k] + s[k]], axis=1) if len(k) else np.empty((0, 2), np.int64)
    return tracks


def merged(ranges: np.ndarray) -> np.ndarray:
    """Byte ranges with neighbours that touch made one."""
    if not len(ranges):
        return ranges
    cut = np.flatnonzero(ranges[1:, 0] != ranges[:-1, 1]) + 1
    return np.stack([ranges[np.concatenate([[0], cut]), 0], ranges[np.concatenate([cut - 1, [len(ranges) - 1]]), 1]], axis=1)


def payload_of(media: bytes, track: dict) -> bytes:
    """The track's sample bytes in order; neighbouring samples are taken in one slice."""
    o, s = track["offsets"], track["sizes"]
    if not len(o):
        return b""
    cut = np.flatnonzero(o[1:] != o[:-1] + s[:-1]) + 1
    starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(o)]]) - 1
    return b"".join(media[o[a] : o[b] + s[b]] for a, b in zip(starts, ends))


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: every text (null: empty) as UTF-8, padded with zero bytes to a positive multiple of 64, in a container."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows, held = [], 0
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                raw = (text.as_py() or "").encode()
                media = write_container(raw + bytes(max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw)))
                rows.append((doc, len(raw), media))
                held += len(media)
                if held > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary()))], ["doc_id", "n_bytes", "media"])
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary()))], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


TRACK = "struct<track_id:bigint,codec:string,handler:string,timescale:bigint,duration:bigint,duration_s:double,samples:bigint,n_keyframes:bigint,keyframes:array<struct<start:bigint,end:bigint>>>"


def describe_one(media: bytes | None) -> tuple[list[dict], bytes | None, str | None]:
    """(tracks as in TRACK, the first track's payload, error) of one file. Broken and null files have no tracks, but an error."""
    if media is None:
        return [], None, "null"
    try:
        tracks = read_container(media)
    except ValueError as e:
        return [], None, str(e)[:200]
    out = []
    for t in tracks:
        spans = [{"start": int(a), "end": int(b)} for a, b in merged(t["ranges"])]
        seconds = t["duration"] / t["timescale"] if t["timescale"] else None
        out.append({"track_id": t["track_id"], "codec": t["codec"], "handler": t["handler"], "timescale": t["timescale"], "duration": t["duration"], "duration_s": seconds, "samples": len(t["sizes"]), "n_keyframes": len(t["keyframes"]), "keyframes": spans})
    return out, payload_of(media, tracks[0]) if tracks else None, None


def describe_media(media: DataFrame) -> DataFrame:
    """media (a binary column ``media``) as it is, but for that column, plus media_bytes, media_sha256, tracks (codec, duration, keyframe byte ranges
    and more, per track), payload_bytes, payload_sha256 and tail_crc32 of the first track as stored, and error.

    Neighbouring keyframes are one range. A null, empty or broken file is a row with an error and no tracks; several tracks are several
    elements; a timescale of 0 gives no duration in seconds. Repeated rows agree; an empty table gives no rows.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kept = [c for c in media.columns if c != "media"]
    made = "media_bytes long, media_sha256 string, tracks array<" + TRACK + ">, payload_bytes long, payload_sha256 string, tail_crc32 long, error string"
    schema = StructType([media.schema[c] for c in kept] + list(StructType.fromDDL(made)))
    arrow = to_arrow_schema(schema)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = []
            for m in b.column("media"):
                data = m.as_py()
                tracks, body, error = describe_one(data)
                seen = (None, None) if data is None else (len(data), hashlib.sha256(data).hexdigest())
                own = (None, None, None) if body is None else (len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-UNIT:]))
                rows.append((*seen, tracks, *own, error))
            types = [arrow.field(i).type for i in range(len(kept), len(arrow))]
            yield pa.RecordBatch.from_arrays([*(b.column(c).cast(arrow.field(c).type) for c in kept), *(pa.array(c, t) for c, t in zip(zip(*rows), types))], arrow.names) if rows else pa.RecordBatch.from_pylist([], schema=arrow)

    return media.select(*kept, "media").mapInArrow(run, schema)


def media_columns(docs: DataFrame) -> DataFrame:
    """Store docs' texts as containers in the shared folder and describe them from what was stored: one row per row of docs (doc_id, text).

    doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, codec, duration_s, keyframes. A null text is
    empty; an empty one is 64 zero bytes; long ones are stored whole; equal texts have equal values; other columns are ignored.
    """
    d = describe_media(materialize(to_media(docs), "media"))
    t = F.col("tracks")[0]
    told = F.concat_ws(";", *[F.concat(F.lit(f"{c}="), t[c].cast("string")) for c in ("codec", "handler", "timescale", "duration", "samples", "n_keyframes")], F.concat(F.lit("ranges="), F.array_join(F.transform(t["keyframes"], lambda k: F.concat_ws("-", k["start"].cast("string"), k["end"].cast("string"))), ",")))
    return d.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", told.alias("feature"), t["codec"].alias("codec"), t["duration_s"].alias("duration_s"), t["keyframes"].alias("keyframes"))
