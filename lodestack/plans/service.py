"""What a service around the index needs: admission, bearer tokens, request bodies."""

from __future__ import annotations

import hmac
import json
import threading
import time
from contextlib import contextmanager, nullcontext
from dataclasses import fields

from lodestack.operators.quality import BUCKETS_MS
from lodestack.plans.config import SearchRequest
from lodestack.plans.index import GenerationConflict, Index
from lodestack.sources.ingest import parse_batch, parse_ops


class Overloaded(RuntimeError):
    """Too many requests or bytes are in flight."""


class Admission:
    """At most so many requests and body bytes at a time."""

    def __init__(self, max_inflight: int, max_bytes: int):
        self._lock, self._free, self._room = threading.Lock(), max_inflight, max_bytes

    @contextmanager
    def admit(self, size: int):
        with self._lock:
            if self._free < 1 or self._room < size:
                raise Overloaded
            self._free -= 1
            self._room -= size
        try:
            yield
        finally:
            with self._lock:
                self._free += 1
                self._room += size


def authorised(header: str | None, token: str) -> bool:
    """Whether a bearer header holds the token, in time that doesn't depend on it."""
    scheme, _, given = (header or "").partition(" ")
    return hmac.compare_digest(given.encode(), token.encode()) and scheme.lower() == "bearer"


def request_of(body: dict, retrieve: bool = False) -> SearchRequest:
    """A request from a JSON body; unknown keys and wrong kinds are a ValueError."""
    names = {f.name for f in fields(SearchRequest)} - {"extra", "offset", "w_lex", "w_vec", "stats_scope", "exact"}
    names -= {"scope", "cursor"} if retrieve else {"max_passages_per_document", "max_context_bytes"}
    if not isinstance(body, dict) or set(body) - names:
        raise ValueError(f"unknown fields {sorted(set(body) - names) if isinstance(body, dict) else body!r}")
    kinds = dict(query=str, vector=list, mode=str, scope=str, operator=str, limit=int, phrase=bool, filter=dict, cursor=str, max_passages_per_document=int, max_context_bytes=int)
    if any(k in body and (not isinstance(body[k], kind) or kind is int and isinstance(body[k], bool)) for k, kind in kinds.items()):
        raise ValueError("a field has the wrong kind")
    made = dict(body)
    if "vector" in made:
        if not all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in made["vector"]):
            raise ValueError("a vector holds numbers")
        made["vector"] = tuple(float(x) for x in made["vector"])
    made.setdefault("limit", 10)
    return SearchRequest(**made)


def prepare(index: Index, body: dict) -> dict:
    """Passages of one document (id, body) and the model that its vectors have to come from."""
    if not isinstance(body, dict) or set(body) != {"id", "body"} or not all(isinstance(v, str) for v in body.values()) or not body["id"]:
        raise ValueError("a document to prepare has an id and a body")
    rows = index.prepare(index.spark.createDataFrame([(body["id"], body["body"])], "id string, body string")).orderBy("ordinal").collect()
    keys = ("passage_id", "document_id", "ordinal", "start_char", "end_char", "text")
    return {"embedding_model": index.config.model_id or None, "passages": [{k: r[k] for k in keys} for r in rows]}


def write_batch(index: Index, body: dict) -> dict:
    """Apply {"operations": [...]} as one generation."""
    ops = parse_ops(parse_batch(index.spark.createDataFrame([(json.dumps(body),)], "value string")))
    bad = ops.where("error is not null").orderBy("pos").limit(1).collect()
    if bad:
        raise ValueError(f"operation {bad[0]['pos']}: {bad[0]['error']}")
    r = index.apply(ops.drop("pos"))
    return {"generation": r.generation, "accepted": r.accepted, "upserts": r.upserts, "deletes": r.deletes, "segment_ids": list(r.segment_ids)}


class Meter:
    """Counts requests by operation and class of status, and their times in buckets."""

    def __init__(self):
        self._lock, self.counts, self.times = threading.Lock(), {}, {}

    def saw(self, op: str, status: int, ms: float) -> None:
        with self._lock:
            key = (op, f"{status // 100}xx")
            self.counts[key] = self.counts.get(key, 0) + 1
            h = self.times.setdefault(op, [[0] * len(BUCKETS_MS), 0, 0.0])
            h[0] = [n + (ms <= b) for n, b in zip(h[0], BUCKETS_MS)]
            h[1], h[2] = h[1] + 1, h[2] + ms

    def render(self, index: Index, prefix: str = "lodestack") -> str:
        """Text exposition of the requests and of the index's segments."""
        segments = index.snapshot().segments
        sizes = [s["bytes"] for s in segments]
        lines = [f"{prefix}_generation {index.generation()}", f"{prefix}_segments {len(sizes)}", f"{prefix}_bytes {sum(sizes)}", f"{prefix}_segment_bytes_min {min(sizes, default=0)}", f"{prefix}_segment_bytes_max {max(sizes, default=0)}"]
        lines += [f"{prefix}_segment_rows {sum(s['rows'] for s in segments)}", f"{prefix}_passages {sum(s['passages'] for s in segments)}", f'{prefix}_compaction{{state="{index.status()["state"]}"}} 1']
        with self._lock:
            lines += [f'{prefix}_requests{{op="{op}",status="{status}"}} {n}' for (op, status), n in sorted(self.counts.items())]
            for op, (buckets, n, total) in sorted(self.times.items()):
                lines += [f'{prefix}_request_ms_bucket{{op="{op}",le="{b}"}} {k}' for b, k in zip(BUCKETS_MS, buckets)]
                lines += [f'{prefix}_request_ms_bucket{{op="{op}",le="+Inf"}} {n}', f'{prefix}_request_ms_count{{op="{op}"}} {n}', f'{prefix}_request_ms_sum{{op="{op}"}} {round(total, 3)}']
        return "\n".join(lines) + "\n"


def _answer(index: Index, route: str, body: dict, meter: Meter | None) -> tuple[int, dict]:
    try:
        if route == "search":
            return 200, index.response(request_of(body))
        if route == "retrieve":
            r = index.retrieve(request_of(body, retrieve=True)).first()
            return 200, {"context": r.context, "used_bytes": r.used_bytes, "citations": [c.asDict() for c in r.citations]}
        if route == "passages:prepare":
            return 200, prepare(index, body)
        if route == "documents:batch":
            return 200, write_batch(index, body)
        if route in ("live", "ready"):
            return 200, {"generation": index.generation()}
        if route == "metrics":
            return 200, {"text": (meter or Meter()).render(index)}
        return 404, {"error": "not_found"}
    except ValueError as e:
        return 400, {"error": "invalid_request", "detail": str(e)}
    except GenerationConflict as e:
        return 409, {"error": "conflict", "detail": str(e)}
    except Overloaded:
        return 503, {"error": "overloaded"}


def handle(index: Index, route: str, body: dict, meter: Meter | None = None, admission: Admission | None = None) -> tuple[int, dict]:
    """(status, answer) of search, retrieve, passages:prepare, documents:batch, live, ready and metrics."""
    began = time.perf_counter()
    size = len(json.dumps(body)) if body else 0
    try:
        with admission.admit(size) if admission else nullcontext():
            status, answer = _answer(index, route, body, meter)
    except Overloaded:
        status, answer = 503, {"error": "overloaded"}
    if meter is not None and route != "metrics":
        meter.saw(route, status, 1000 * (time.perf_counter() - began))
    return status, answer
