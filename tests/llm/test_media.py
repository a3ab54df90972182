import hashlib
import struct
import zlib

import pytest

from lodestack.llm.media import _box, _full, describe_media, media_columns, merged, payload_of, read_container, write_container
from tests.llm import cases


@pytest.mark.parametrize("units", [1, 15, 16, 17, 63, 64, 65, 128, 1000])
def test_container_round_trip(units):
    payload = bytes(i * 7 % 256 for i in range(units * 64))
    media = write_container(payload)
    (t,) = read_container(media)
    assert payload_of(media, t) == payload and t["codec"] == "raw" and t["duration"] == units * 64
    assert all(media[a:b] == payload[k * 64 : k * 64 + 64] for k, (a, b) in enumerate(t["ranges"])) and len(t["ranges"]) == units
    ((a, b),) = merged(t["ranges"])
    assert media[a:b] == payload


def test_broken_boxes_are_refused():
    media = write_container(bytes(640))
    for bad in (media[:-3], struct.pack(">I4s", 7, b"moov"), media.replace(b"stco", struct.pack(">4s", b"free"))):
        with pytest.raises(ValueError):
            read_container(bad)


def video(sizes, chunks, per, keys=None, track=1, codec=b"avc1", timescale=90, stsz=None):
    """A trak box with these sample sizes, chunk offsets, samples per chunk and sync samples."""
    tables = [
        _full(b"stsd", struct.pack(">I", 1), _box(codec, bytes(78))),
        _full(b"stts", struct.pack(">III", 1, len(sizes), 3)),
        _full(b"ctts", struct.pack(">III", 1, len(sizes), 1)),
        _full(b"stsc", struct.pack(">I", len(per)), b"".join(struct.pack(">III", *r, 1) for r in per)),
        stsz or _full(b"stsz", struct.pack(">II", 0, len(sizes)), struct.pack(f">{len(sizes)}I", *sizes)),
        _full(b"co64", struct.pack(">I", len(chunks)), struct.pack(f">{len(chunks)}Q", *chunks)),
    ]
    if keys is not None:
        tables.append(_full(b"stss", struct.pack(">I", len(keys)), struct.pack(f">{len(keys)}I", *keys)))
    mdhd = _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, timescale, 3 * len(sizes), 0, 0))
    hdlr = _full(b"hdlr", struct.pack(">I4s12x", 0, b"vide"), b"\0")
    return _box(b"trak", _full(b"tkhd", struct.pack(">IIII", 0, 0, track, 0), bytes(64)), _box(b"mdia", mdhd, hdlr, _box(b"minf", _box(b"stbl", *tables))))


def test_two_tracks_with_interleaved_chunks_and_sync_samples():
    data = bytes(range(200))
    mdat = _box(b"mdat", data)
    at = lambda k: 8 + k  # noqa: E731  the mdat comes first
    a = video([10, 20, 30, 5], [at(0), at(100)], [(1, 3), (2, 1)], [1, 4])
    b = video([7, 8], [at(60)], [(1, 2)], None, 2, b"mp4a", 0, _full(b"stz2", struct.pack(">II", 8, 2), bytes([7, 8])))
    first, second = read_container(mdat + _box(b"moov", a, b))
    assert payload_of(mdat, first) == data[:60] + data[100:105] and [tuple(x) for x in first["ranges"]] == [(8, 18), (108, 113)]
    assert (first["codec"], first["duration"], first["track_id"]) == ("avc1", 12, 1)
    assert payload_of(mdat, second) == data[60:75] and [tuple(x) for x in merged(second["ranges"])] == [(68, 83)] and second["codec"] == "mp4a"


def test_fragments():
    moov = _box(b"moov", video([], [], []), _box(b"mvex", _full(b"trex", struct.pack(">5I", 1, 1, 3, 4, 1 << 16))))
    trun = lambda offset: _full(b"trun", struct.pack(">IiI", 3, offset, 0), struct.pack(">3I", 5, 6, 7), flags=0x205)
    traf = lambda offset: _box(b"moof", _full(b"mfhd", struct.pack(">I", 1)), _box(b"traf", _full(b"tfhd", struct.pack(">I", 1), flags=0x20000), trun(offset)))
    size = len(traf(0))
    media = moov + traf(size + 8) + _box(b"mdat", bytes(range(18)))
    (t,) = read_container(media)
    assert payload_of(media, t) == bytes(range(18)) and t["keyframes"].tolist() == [0] and t["duration"] == 9
    assert [media[a:b] for a, b in t["ranges"]] == [bytes(range(5))]


def test_bad_files_are_rows_with_an_error(spark):
    good = write_container(bytes(64))
    rows = [(1, good), (2, None), (3, b""), (4, good[:-5]), (5, b"junk" * 9), (6, good.replace(b"stsz", b"free"))]
    got = {r.media_id: r for r in describe_media(spark.createDataFrame(rows, "media_id long, media binary")).collect()}
    assert got[1].error is None and got[1].tracks[0].codec == "raw" and len(got[1].tracks[0].keyframes) == 1 and got[1].payload_bytes == 64
    assert [got[i].error is not None for i in (2, 4, 5, 6)] == [True] * 4 and got[3].tracks == [] and got[2].media_bytes is None


def test_rows_match_brute_force(spark, tmp_path):
    rows = cases.rows(20)
    got = media_columns(cases.stored(spark, tmp_path / "d", rows)).collect()
    want = []
    for d, t, *_ in rows:
        raw = (t or "").encode()
        p = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        want.append((str(d), len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), hashlib.sha256(write_container(p)).hexdigest()))
    assert sorted((str(r.doc_id), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_sha256) for r in got) == sorted(want)


def test_empty_table(spark, tmp_path):
    assert media_columns(cases.stored(spark, tmp_path / "d", [])).count() == 0
