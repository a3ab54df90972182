"""Text functions: normalisation, tokens, passages, snippets, stable ids."""

from __future__ import annotations

import bisect
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{M}\p{N}]+"
#: The same runs; the JVM tests its ASCII part by a bit set first.
JVM_TOKEN = r"[a-z0-9\p{L}\p{M}\p{N}]+"
CHUNK_MAX, CHUNK_OVERLAP = 1200, 200
CHUNK_FIELDS = {"ordinal": "int", "start_char": "int", "end_char": "int", "text": "string", "passage_id": "string"}


def tokens(text: Column) -> Column:
    """The simple profile: lower-cased runs of letters, marks and digits, in order. Null gives an empty array."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(JVM_TOKEN), F.lit(0)), F.expr("cast(array() as array<string>)"))


#: How texts become terms: "simple" runs in the JVM, "unicode" follows the word boundaries of folded text.
PROFILES = ("simple", "unicode")


def profile_tokens(text: Column, profile: str = "simple") -> Column:
    """The tokens of a column under a profile."""
    if profile not in PROFILES:
        raise ValueError(f"no tokenizer {profile!r}; there are {PROFILES}")
    return tokens(text) if profile == "simple" else unicode_tokens(text)


def query_tokens(query: str, profile: str = "simple") -> list[str]:
    """The tokens of a query string on the driver."""
    import regex

    if profile not in PROFILES:
        raise ValueError(f"no tokenizer {profile!r}; there are {PROFILES}")
    return regex.findall(TOKEN, query.lower()) if profile == "simple" else [w for w, _, _ in word_tokens(query)]


def valid_utf8(raw: Column) -> Column:
    """Whether bytes are valid UTF-8; null stays null."""
    return F.is_valid_utf8(raw)


def fold(text: str) -> str:
    """Compatibility case folding: NFKC of the case-folded text without default-ignorable code points."""
    if text.isascii():  # nothing to compose, decompose or ignore
        return text.lower()
    import regex

    step = unicodedata.normalize("NFKC", unicodedata.normalize("NFD", text).casefold())
    step = unicodedata.normalize("NFKC", step.casefold())
    return unicodedata.normalize("NFKC", regex.sub(r"\p{Default_Ignorable_Code_Point}", "", step))


def word_tokens(text: str) -> list[tuple[str, int, int]]:
    """The unicode profile: (token, start, end) in the folded text by word boundaries, pieces with a letter or digit."""
    import regex

    folded = fold(text)
    return [(m[0], m.start(), m.end()) for m in regex.finditer(r"(?w).+?\b", folded, flags=regex.DOTALL) if regex.search(r"[\p{L}\p{N}]", m[0])]


def normalize_nfkc(text: Column | str) -> Column:
    """fold() as an Arrow-batched column."""

    def run(texts: pa.Array) -> pa.Array:
        return pa.concat_arrays([pa.array([None if t is None else fold(t) for t in part.to_pylist()], pa.string()) for part in _parts(texts)])

    return F.arrow_udf(run, "string")(text)


#: Texts, and bytes of their Arrow array, of which there are Python objects at once, about.
PART_ROWS, PART_BYTES = 512, 1 << 21


def _parts(texts: pa.Array) -> list[pa.Array]:
    """Neighbouring slices of a column of texts; one that is empty if it is."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    part = np.maximum.accumulate(np.arange(len(texts)) // PART_ROWS + sizes // PART_BYTES)
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
    return [texts.slice(a, b - a) for a, b in zip(cuts, cuts[1:])]


def unicode_tokens(text: Column | str) -> Column:
    """The tokens of word_tokens() as an Arrow-batched column."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [] if t is None else [w for w, _, _ in word_tokens(t)])

    return F.pandas_udf(run, "array<string>")(text)


# -- passages

_SENTENCE = re.compile(r"[.!?。！？]+[\"'”’)\]»]*(?:\s+|$)|\n+|(?<=[。！？])")


def _fnv(h: int, data: bytes) -> int:
    for byte in data:
        h = (h ^ byte) * 1099511628211 & 0xFFFFFFFFFFFFFFFF
    return h


def fnv_passage_id(document_id: str, ordinal: int, text: str) -> str:
    """p- and 16 hex digits: a 64-bit multiply-xor hash of id bytes, ordinal and text bytes."""
    h = _fnv(1469598103934665603, document_id.encode())
    h = (h ^ (ordinal & 0xFFFFFFFF)) * 1099511628211 & 0xFFFFFFFFFFFFFFFF
    return f"p-{_fnv(h, text.encode()):016x}"


#: Passages that are hashed at once, and bytes of the longest of them; longer ones are hashed alone.
HASHED, HASHED_BYTES = 2048, 1 << 13


def fnv_passage_ids(keys: list[tuple[str, int, str]]) -> list[str]:
    """fnv_passage_id() of many passages at once: one step a byte place for HASHED of them, the longest first, so that a step has only those that go on."""
    texts, prime, begun, out = [t.encode() for _, _, t in keys], np.uint64(1099511628211), {}, [""] * len(keys)
    for d, _, _ in keys:
        if d not in begun:
            begun[d] = _fnv(1469598103934665603, d.encode())
    order = sorted(range(len(keys)), key=lambda i: -len(texts[i]))
    while order and len(texts[order[0]]) > HASHED_BYTES:
        out[order[0]] = fnv_passage_id(*keys[order[0]])
        order = order[1:]
    for at in range(0, len(order), HASHED):
        mine = order[at : at + HASHED]
        sizes = np.array([len(texts[i]) for i in mine])
        grid = np.zeros((len(mine), int(sizes[0])), np.uint8)
        for row, i in zip(grid, mine):
            row[: len(texts[i])] = np.frombuffer(texts[i], np.uint8)
        grid = np.ascontiguousarray(grid.T)
        h = (np.array([begun[keys[i][0]] for i in mine], np.uint64) ^ np.array([keys[i][1] & 0xFFFFFFFF for i in mine], np.uint64)) * prime
        left = np.searchsorted(-sizes, -np.arange(len(grid)), side="left")  # passages longer than each place
        for column, m in zip(grid, left.tolist()):
            h[:m] = (h[:m] ^ column[:m]) * prime
        for i, x in zip(mine, h.tolist()):
            out[i] = f"p-{x:016x}"
    return out


def graphemes(text: str) -> list[int]:
    """Grapheme boundaries, with 0 and the length."""
    import regex

    return [0, *(m.end() for m in regex.finditer(r"\X", text))]


_JOINERS = "".join(rf"\p{{Grapheme_Cluster_Break={x}}}" for x in ("Extend", "ZWJ", "SpacingMark", "Prepend", "L", "V", "T", "LV", "LVT", "Regional_Indicator"))


def _may_join(text: str) -> bool:
    """Whether code points of a text may be parts of longer graphemes."""
    import regex

    return "\r\n" in text or not text.isascii() and regex.search(f"[{_JOINERS}]", text) is not None


def sentence_chunks(document_id: str, text: str, most: int = CHUNK_MAX, overlap: int = CHUNK_OVERLAP) -> Iterator[tuple[int, int, int, str, str]]:
    """sentence_places() with passage ids."""
    found = list(sentence_places(text, most, overlap))
    for (o, a, b, t), p in zip(found, fnv_passage_ids([(document_id, o, t) for o, _, _, t in found])):
        yield o, a, b, t, p


def sentence_places(text: str, most: int = CHUNK_MAX, overlap: int = CHUNK_OVERLAP) -> Iterator[tuple[int, int, int, str]]:
    """(ordinal, start, end, text) of the passages of folded text: the longest run of graphemes up to ``most`` code points, ended at its last sentence boundary
    if it has one; blank pieces are skipped without using an ordinal; the next passage begins ``overlap`` back."""
    if not 0 <= overlap < most:
        raise ValueError("the overlap has to be smaller than a passage")
    text = fold(text)
    n, ordinal, start = len(text), 0, 0
    if not _may_join(text):  # every code point is a grapheme
        ends = sorted({m.end() for m in _SENTENCE.finditer(text)} | {n})
        while start < n:
            limit = min(start + most, n)
            j = bisect.bisect_right(ends, limit) - 1
            end = ends[j] if j >= 0 and ends[j] > start else limit
            piece = text[start:end]
            if not piece.strip():
                start = end
                continue
            yield ordinal, start, end, piece
            if end == n:
                return
            ordinal += 1
            start = max(end - overlap, start + 1)
        return
    edges = graphemes(text)
    place = {e: i for i, e in enumerate(edges)}
    ends = sorted({m.end() for m in _SENTENCE.finditer(text) if m.end() in place} | {n})
    while start < n:
        k = bisect.bisect_right(edges, start + most) - 1
        limit = edges[k] if edges[k] > start else edges[place[start] + 1]
        j = bisect.bisect_right(ends, limit) - 1
        end = ends[j] if j >= 0 and ends[j] > start else limit
        piece = text[start:end]
        if not piece.strip():
            if end == n:
                return
            start = end
            continue
        yield ordinal, start, end, piece
        ordinal += 1
        if end == n:
            return
        i = place[end]
        while end - edges[i] < overlap and edges[i - 1] > start:
            i -= 1
        start = edges[i]


def sentence_passages(most: int = CHUNK_MAX, overlap: int = CHUNK_OVERLAP, fields: tuple[str, ...] = tuple(CHUNK_FIELDS)):
    """(id, text) -> array of passages, of which only ``fields`` are made, as a function of Arrow arrays; few documents at a time are Python objects."""
    kinds = {f: {"int": pa.int32(), "string": pa.string()}[CHUNK_FIELDS[f]] for f in fields}

    def run(ids: pa.Array, texts: pa.Array) -> pa.Array:
        sizes, columns, at = [], {f: [] for f in fields}, 0
        for part in _parts(texts):
            rows, keys = [], []
            for i, x in zip(ids.slice(at, len(part)).to_pylist(), part.to_pylist()):
                before = len(rows)
                for o, a, b, t in sentence_places(x or "", most, overlap):
                    rows.append((o, a, b, t))
                    keys.append((i, o, t))
                sizes.append(len(rows) - before)
            at += len(part)
            found = dict(zip(("ordinal", "start_char", "end_char", "text"), zip(*rows))) if rows else {}
            if "passage_id" in kinds:
                found["passage_id"] = fnv_passage_ids(keys)
            for f in fields:
                columns[f].append(pa.array(found.get(f, []), kinds[f]))
        values = pa.StructArray.from_arrays([pa.concat_arrays(columns[f]) for f in fields], fields=[pa.field(f, kinds[f]) for f in fields])
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), values)

    return F.arrow_udf(run, f"array<struct<{','.join(f'{f}:{CHUNK_FIELDS[f]}' for f in fields)}>>")


def window_passages(text: Column, most: int = 400, overlap: int = 50) -> Column:
    """Fixed windows, JVM-side: array of (ordinal, start_char, end_char, text)."""
    step = most - overlap
    last = F.greatest(F.lit(0), F.ceil((F.length(text) - most) / step)).cast("int")
    return F.transform(
        F.sequence(F.lit(0), last),
        lambda o: F.struct(o.alias("ordinal"), (o * step).alias("start_char"), F.least(o * step + most, F.length(text)).alias("end_char"), F.substring(text, o * step + 1, F.lit(most)).alias("text")),
    )


# -- snippets


def snippet_window(text: Column, terms: list[str], most: int = 180) -> Column:
    """The window of up to ``most`` code points around the earliest listed term that occurs, else the start of the text."""
    focus = F.lit(0)
    for term in reversed(terms):
        at = F.instr(text, term)
        focus = F.when(at > 0, at - 1).otherwise(focus)
    start = F.greatest(F.lit(0), focus - most // 2)
    start = F.greatest(F.lit(0), F.least(start, F.length(text) - most))
    return F.substring(text, start + 1, F.lit(most))


def highlight(window: Column, terms: list[str], opening: str = "<mark>", closing: str = "</mark>") -> Column:
    """Marks every occurrence of the terms, longest first at each place; special characters are literal."""
    pattern = "|".join(re.escape(t) for t in sorted(terms, key=lambda t: (-len(t), t)))
    return F.regexp_replace(window, f"({pattern})", f"{opening}$1{closing}") if terms else window


def snippet_graphemes(text: str, terms: list[str], most: int = 180) -> str:
    """The grapheme-exact window for one text."""
    edges = graphemes(text)
    place = {e: i for i, e in enumerate(edges)}
    focus = 0
    for term in terms:
        at = text.find(term) if term else -1
        while at >= 0 and not (at in place and at + len(term) in place):
            at = text.find(term, at + 1)
        if at >= 0:
            focus = place[at]
            break
    a = max(0, focus - most // 2)
    b = min(len(edges) - 1, a + most)
    return text[edges[max(0, min(a, b - most))] : edges[b]]


def snippets(text: Column | str, terms: list[str], most: int = 180) -> Column:
    """snippet_graphemes() as an Arrow-batched column, for the few rows of a page."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else snippet_graphemes(t, terms, most))

    return F.pandas_udf(run, "string")(text)


# -- ids, truncation, splitting


def truncate_bytes(text: str, most: int) -> str:
    """At most ``most`` UTF-8 bytes, without cutting a code point."""
    return text.encode()[:most].decode("utf-8", "ignore")


def split_text(text: str, most: int) -> list[str]:
    """Lossless parts of at most ``most`` UTF-8 bytes; a part ends after the last blank line or line break in its second half, if any."""
    raw, out, at = text.encode(), [], 0
    while len(raw) - at > most:
        end = at + most
        while end > at and raw[end] & 0xC0 == 0x80:  # not inside a code point
            end -= 1
        if end == at:
            raise ValueError("a part can't hold one character")
        for mark in (b"\n\n", b"\n"):
            found = raw.rfind(mark, at, end)
            if found >= 0 and found + len(mark) - at > most // 2:
                end = found + len(mark)
                break
        out.append(raw[at:end].decode())
        at = end
    return out + [raw[at:].decode()] if at < len(raw) or not out else out


def truncate_utf8(most: int):
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else truncate_bytes(t, most))

    return F.pandas_udf(run, "string")


def split_body(most: int):
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [] if t is None else split_text(t, most))

    return F.pandas_udf(run, "array<string>")


def stable_document_id(collection: str, path: Column, part: Column) -> Column:
    digest = F.sha2(F.concat(F.lit(collection + "\0"), path), 256)
    return F.concat(F.lit(f"lf:v1:{collection}:"), digest, F.lit(":p"), F.lpad(part.cast("string"), 10, "0"))
