import hashlib
import io

from lodestack.llm.warc import MAGIC, archive_and_read, read_archive, record, write_archive, write_warc

SCHEMA = "page_id long, url string, html string, digest string, refers_to long"


def pages():
    long = "<p>" + "é" * 60
    rows = [(i, f"https://h.example/{i}\r\nX: y", long if i % 3 == 0 else f"<html>{i}" + " body" * i) for i in range(1, 90)]
    rows += [(200, None, None), (201, "u", ""), (None, "u", long), (None, "u", "only null" * 20), (202, "u", "x" * 3_000_000), (203, "u", "short"), (204, "u", "short"), rows[0], rows[5]]
    return [(*r, "clash", 1) for r in rows]


def test_round_trip_matches_brute_force(spark, tmp_path):
    spark.createDataFrame(pages(), SCHEMA).write.parquet(str(tmp_path / "p"))
    got = archive_and_read(spark.read.parquet(str(tmp_path / "p"))).collect()
    assert all(r.intact for r in got) and len(got) == len(pages())
    first = {}
    for p, _, h, *_ in pages():
        b = (h or "").encode()
        if len(b) >= 100 and p is not None:
            first[b] = min(p, first.get(b, p))
    want = []
    for p, _, h, *_ in pages():
        b = (h or "").encode()
        ref = first.get(b)
        ref = ref if ref is not None and ref != p else None
        want.append((p, len(b), hashlib.sha256(b).hexdigest(), "revisit" if ref is not None else "response", ref))
    key = lambda r: tuple(map(str, r))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=key) == sorted(want, key=key)


def test_dictionary_leads_and_frames_stand_alone():
    bodies = [b"<html>%d" % i + b" common words of every page" * 20 for i in range(3000)]
    sink = io.BytesIO()
    write_archive((record(i, "u", b, hashlib.sha256(b).hexdigest(), None) for i, b in enumerate(bodies)), sink)
    raw = sink.getvalue()
    assert int.from_bytes(raw[:4], "little") == MAGIC and len(raw) < sum(map(len, bodies)) / 4
    assert [r["payload"] for r in read_archive(io.BytesIO(raw))] == bodies


def test_empty_table(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    assert archive_and_read(empty).count() == 0
    assert write_warc(empty, str(tmp_path / "w")).count() == 0
