"""Index configuration and search requests."""

from __future__ import annotations

import hashlib
import json
import math
from dataclasses import asdict, dataclass, field

from lodestack.functions.filters import MAX_FIELD_BYTES, MAX_FIELDS
from lodestack.functions.scoring import METRICS
from lodestack.functions.text import PROFILES

COMPACT = (",", ":")


@dataclass(frozen=True)
class IndexConfig:
    tokenizer_id: str = "simple"
    chunk_max_chars: int = 1200
    chunk_overlap_chars: int = 200
    vectors: bool = False
    model_id: str = ""
    dimensions: int = 0
    metric: str = "cosine"
    filterable_fields: tuple[str, ...] = ()

    def __post_init__(self):
        if self.tokenizer_id not in PROFILES:
            raise ValueError(f"no tokenizer {self.tokenizer_id!r}; there are {PROFILES}")
        if not 0 <= self.chunk_overlap_chars < self.chunk_max_chars:
            raise ValueError("the overlap has to be smaller than a chunk")
        if self.vectors and not (1 <= self.dimensions <= 65536 and self.metric in METRICS and self.model_id):
            raise ValueError("vectors need a model, 1 to 65536 dimensions and a metric")
        names = sorted(set(self.filterable_fields))
        if len(names) > MAX_FIELDS or any(not n or len(n.encode()) > MAX_FIELD_BYTES for n in names):
            raise ValueError("bad filterable fields")
        object.__setattr__(self, "filterable_fields", tuple(names))

    @staticmethod
    def from_toml(text: str) -> "IndexConfig":
        import tomllib

        t = tomllib.loads(text)
        index, vector = t.get("index", {}), t.get("vector", {})
        return IndexConfig(
            tokenizer_id=t.get("tokenizer", {}).get("id", "simple"), chunk_max_chars=t.get("chunk", {}).get("max_chars", 1200), chunk_overlap_chars=t.get("chunk", {}).get("overlap_chars", 200),
            vectors=vector.get("enabled", False), model_id=vector.get("model_id", ""), dimensions=vector.get("dimensions", 0), metric=vector.get("metric", "cosine"), filterable_fields=tuple(index.get("filterable_fields", ())),
        )

    def fingerprint(self) -> str:
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()


@dataclass(frozen=True)
class SearchRequest:
    query: str | None = None
    vector: tuple[float, ...] | None = None
    mode: str = "hybrid"
    scope: str = "documents"
    operator: str = "or"
    phrase: bool = False
    filter: dict | None = None
    limit: int = 10
    offset: int = 0
    w_lex: float = 1.0
    w_vec: float = 1.0
    max_passages_per_document: int = 3
    max_context_bytes: int = 16384
    stats_scope: str = "visible"
    cursor: str | None = None
    exact: bool = False  # leave the inverted file of vectors aside
    extra: dict = field(default_factory=dict)

    def check(self, config: IndexConfig) -> "SearchRequest":
        """self, or ValueError."""
        if self.mode not in ("lexical", "vector", "hybrid") or self.scope not in ("documents", "passages") or self.operator not in ("or", "and") or self.stats_scope not in ("visible", "physical"):
            raise ValueError("unknown mode, scope or operator")
        if not 1 <= self.limit <= 100 or not 0 <= self.offset <= 10000:
            raise ValueError("limit is 1 to 100, offset 0 to 10000")
        if self.mode != "vector" and self.query is None or self.mode != "lexical" and self.vector is None:
            raise ValueError(f"{self.mode} search needs its query and vector")
        if self.vector is not None and (len(self.vector) != config.dimensions or not all(map(math.isfinite, self.vector))):
            raise ValueError("the vector has the wrong dimensions or isn't finite")
        if self.extra:
            raise ValueError(f"unknown fields {sorted(self.extra)}")
        return self

    @property
    def candidate_k(self) -> int:
        return max(100, self.offset + self.limit + 1)

    def digest(self) -> str:
        same = {k: v for k, v in asdict(self).items() if k in ("mode", "scope", "operator", "phrase", "limit", "query", "vector", "filter")}
        return hashlib.sha256(json.dumps(same, separators=COMPACT, sort_keys=True).encode()).hexdigest()
