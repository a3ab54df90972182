"""WARC archives with one Zstandard dictionary per file.

Writing: copies are found on (digest, page_id) rows alone; bodies are shuffled once, by page and digest, so
a payload that a third of all pages share is spread over all tasks. Each task streams its pages
into one ``.warc.zst`` file below the shared folder: the first records (up to ``SAMPLE_BYTES``) are held back, a
dictionary is trained on them and written as a leading skippable frame (magic 0x184D2A5D), then every record becomes a Zstandard
frame of its own. The file is written under a name of its attempt's own and only listed in the task's result,
so a task that is run again leaves no half or double archive in the index.

Reading: a task streams an archive's frames and parses one record at a time. A revisit's digest and length are those of the response that it
refers to, as that was read; ids and digests alone are joined for that.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.storage import materialize, new_folder

MAGIC = 0x184D2A5D
DICT_BYTES = 64 << 10
SAMPLE_BYTES = 2 << 20
LEVEL = 3
MIN_REVISIT = 100


def mark_revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """pages' page_id, url, html plus digest and refers_to (null for responses).

    Null html is an empty payload. Of equal payloads of at least ``min_bytes`` bytes, rows with the smallest page_id are
    responses (repeated rows of that very page all are), the others revisit it; a null page_id comes last. Empty
    tables give no rows.
    """
    body = F.coalesce(F.col("html"), F.lit(""))
    ids = pages.select("page_id", F.sha2(body, 256).alias("digest"), F.octet_length(body).alias("bytes")).where(F.col("bytes") >= min_bytes)
    firsts = ids.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1 and first_id is not null")
    later = ids.join(firsts, "digest").where(~F.col("page_id").eqNullSafe(F.col("first_id")))
    later = later.select(F.col("digest").alias("_d"), F.col("page_id").alias("_p"), F.col("first_id").alias("refers_to")).distinct()
    rows = pages.select("page_id", "url", "html", F.sha2(body, 256).alias("digest"))
    return rows.join(later, (F.col("digest") == F.col("_d")) & F.col("page_id").eqNullSafe(F.col("_p")), "left").drop("_d", "_p")


def _safe(value: str) -> str:
    """A header value on one line."""
    return "".join(c if c.isprintable() and c not in "\r\n" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in value)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit holds no payload, but its digest and length."""
    kind = "response" if refers_to is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 2024-01-01T00:00:00Z"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_safe(url)}")
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def train(records: list[bytes]) -> bytes:
    """A dictionary of at most DICT_BYTES from these records; their plain bytes where they are too few to train on.

    What it is trained on (an archive's first ``SAMPLE_BYTES``, the first 32 KB of each record) bounds how well it compresses, never what is stored."""
    import zstandard

    if len(records) >= 16:
        try:
            size = min(DICT_BYTES, max(1024, sum(map(len, records)) // 8))
            return zstandard.train_dictionary(size, [r[: 32 << 10] for r in records], k=512, d=8).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(records)[:DICT_BYTES] or b"WARC/1.1\r\n"


def write_archive(records: Iterator[bytes], sink) -> tuple[int, int]:
    """Write records to a file object; returns how many and how many bytes were written."""
    import zstandard

    held, size, count, written = [], 0, 0, 0
    packer = None

    def start() -> None:
        nonlocal packer, written
        words = train(held)
        frame = struct.pack("<II", MAGIC, len(words)) + words
        sink.write(frame)
        written += len(frame)
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(words))

    def put(r: bytes) -> None:
        nonlocal written
        frame = packer.compress(r)
        sink.write(frame)
        written += len(frame)

    for r in records:
        count += 1
        if packer is None:
            held.append(r)
            size += len(r)
            if size >= SAMPLE_BYTES:
                start()
                for h in held:
                    put(h)
                held = []
        else:
            put(r)
    if packer is None:
        start()
        for h in held:
            put(h)
    return count, written


def read_archive(source) -> Iterator[dict]:
    """The records of an archive: page_id, url, type, digest, refers_to, payload (None for a revisit), length."""
    import zstandard

    magic, n = struct.unpack("<II", source.read(8))
    if magic != MAGIC:
        raise ValueError("the archive doesn't begin with a dictionary frame")
    words = zstandard.ZstdCompressionDict(source.read(n))
    stream = zstandard.ZstdDecompressor(dict_data=words).stream_reader(source, read_across_frames=True)
    buffer = bytearray()

    def fill(to: int) -> bool:
        while len(buffer) < to:
            more = stream.read(max(65536, to - len(buffer)))
            if not more:
                return False
            buffer.extend(more)
        return True

    while fill(1):
        end, seen = -1, 0
        while (end := buffer.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(buffer)
            if not fill(seen + 1):
                raise ValueError("a record's head is cut off")
        head = dict(line.split(": ", 1) for line in buffer[:end].decode().split("\r\n")[1:])
        size = int(head["Content-Length"])
        if not fill(end + 4 + size + 4):
            raise ValueError("a record's block is cut off")
        block = bytes(buffer[end + 4 : end + 4 + size])
        del buffer[: end + 8 + size]
        http, _, payload = block.partition(b"\r\n\r\n")
        length = int(http.rsplit(b"Content-Length: ", 1)[1].split(b"\r\n")[0])
        revisit = head["WARC-Type"] == "revisit"
        ref = head.get("WARC-Refers-To", "")[10:-1]
        own = head["WARC-Record-ID"][10:-1]
        yield {
            "page_id": int(own) if own else None,
            "url": head.get("WARC-Target-URI"),
            "type": head["WARC-Type"],
            "digest": head["WARC-Payload-Digest"].removeprefix("sha256:"),
            "refers_to": int(ref) if ref else None,
            "payload": None if revisit else payload,
            "length": length,
        }


def write_warc(pages: DataFrame, folder: str, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """Write pages (page_id, url, html) as archives below folder; returns the stored index (path, records, bytes)."""
    from urllib.parse import urlsplit

    local = folder if urlsplit(folder).scheme else f"file://{folder}"

    def save(batches):
        import pyarrow as pa
        from pyarrow import fs as pafs

        fs, base = pafs.FileSystem.from_uri(local)
        first = next(batches, None)
        while first is not None and first.num_rows == 0:
            first = next(batches, None)
        if first is None:
            return

        def all_records():
            batch = first
            while batch is not None:
                ids, urls, bodies, digests, refs = (batch.column(c) for c in ("page_id", "url", "html", "digest", "refers_to"))
                for i in range(batch.num_rows):
                    body = bodies[i].as_py()
                    yield record(ids[i].as_py(), urls[i].as_py(), b"" if body is None else body.encode(), digests[i].as_py(), refs[i].as_py())
                batch = next(batches, None)

        fs.create_dir(base, recursive=True)
        path = f"{base}/{uuid.uuid4().hex}.warc.zst"
        with fs.open_output_stream(path, compression=None) as sink:
            n, size = write_archive(all_records(), sink)
        yield pa.RecordBatch.from_pydict({"path": [path], "records": [n], "bytes": [size]}, schema=pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    marked = mark_revisits(pages, min_bytes)
    return materialize(marked.mapInArrow(save, "path string, records long, bytes long"), "warc-index")


def read_warc(index: DataFrame, folder: str) -> DataFrame:
    """The records of all archives in the index: page_id, url, payload_bytes, payload_digest, record_type, refers_to, intact.

    The digest of a response is computed from the payload that was read; ``intact`` says that it is the one its header names.
    """
    from urllib.parse import urlsplit

    local = folder if urlsplit(folder).scheme else f"file://{folder}"
    names = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, intact boolean"

    def load(batches):
        import pyarrow as pa
        from pyarrow import fs as pafs

        fs, _ = pafs.FileSystem.from_uri(local)
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("intact", pa.bool_())])
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows = []
                with fs.open_input_stream(path, compression=None) as source:
                    for r in read_archive(source):
                        body = r["payload"]
                        digest = r["digest"] if body is None else hashlib.sha256(body).hexdigest()
                        rows.append({"page_id": r["page_id"], "url": r["url"], "payload_bytes": r["length"], "payload_digest": digest, "record_type": r["type"], "refers_to": r["refers_to"], "intact": digest == r["digest"] and (body is None or len(body) == r["length"])})
                        if len(rows) >= 2000:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    parts = max(1, min(10_000, index.count()))
    return index.select("path").repartition(parts, "path").mapInArrow(load, names)


def resolve(records: DataFrame) -> DataFrame:
    """records of read_warc, revisits with the digest and length of the response they refer to; ``intact`` is false where that is missing or
    not what the revisit's header says. records is a stored table."""
    r = records.alias("r")
    firsts = records.where("record_type = 'response' and page_id is not null").groupBy("page_id", "payload_digest").agg(F.first("payload_bytes").alias("n")).alias("f")
    met = r.join(firsts, F.expr("r.refers_to = f.page_id and r.payload_digest = f.payload_digest"), "left")
    revisit, there = F.col("r.record_type") == "revisit", F.col("f.n").isNotNull()
    return met.select("r.page_id", "r.url", F.when(revisit & there, F.col("f.n")).otherwise(F.col("r.payload_bytes")).alias("payload_bytes"), F.when(revisit & there, F.col("f.payload_digest")).otherwise(F.col("r.payload_digest")).alias("payload_digest"), "r.record_type", "r.refers_to", (F.col("r.intact") & (~revisit | there & (F.col("f.n") == F.col("r.payload_bytes")))).alias("intact"))


def archive_and_read(pages: DataFrame) -> DataFrame:
    """Write pages as archives in the shared folder and read them back: one row per row of pages (page_id, url, html).

    Null html is an empty payload; null ids and urls are left out of the headers and come back null; long payloads are stored whole; repeated
    rows are records of their own; other columns are ignored; an empty table gives no rows.
    """
    folder = new_folder(pages.sparkSession, "warc")
    records = read_warc(write_warc(pages.select("page_id", "url", "html"), folder), folder)
    return resolve(materialize(records, "warc-records"))
