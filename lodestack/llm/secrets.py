"""Secret scans with multipart credential linking (native: DataFrame functions only).

Base kinds are found by one regular expression each: ``assign`` (a keyword, ``:`` or ``=``, a value of six or
more characters), ``access`` (AKIA identifiers of 20 or more) and ``hex`` (runs of 24 or more).

Further scans, one per kind, find *parts* of credentials: the base kinds again, and weak candidates that alone would be noise:
``weak_id`` (user or client names, also in front of a URL's host, short access identifiers), ``weak_secret`` (pass phrases, also in front of a
URL's host, secret keys, bare 40-character keys, mixed hex runs of 16 to 23) and ``endpoint`` (URLs, host:port). Parts are joined by their intervals inside a scope, a paragraph
between blank lines: two parts co-occur if at most ``reach`` code points lie between them (``None``: anywhere in the scope). Parts may overlap, as credentials in
a URL do; but an identifier and a secret of which one lies inside the other (a key's name and its value) are no pair. A weak identifier is reported only
beside a secret, a weak secret only beside an identifier, an endpoint only beside both.

Places come from the lengths of what lies between matches, summed by a window per text; the interval join asks
for the nearest part of each role before and after, so it is linear in the parts of a text and makes no pairs.
Only texts' matches are shuffled, by a row number, so neither hot sources nor copies matter. Rows need a
deterministic input (a stored table), since the row number has to be the same if a task is run again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestack.llm.common import text_of

REACH = 200
KINDS = ("assign", "access", "hex", "weak_id", "weak_secret", "endpoint")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # the leftmost run of 20 or more is the leftmost run, kept if long enough
HEX = r"[0-9a-f]{24,}"

_VALUE = r"""["']?\x20{0,8}[:=]\x20{0,8}["']?"""
_USER = r"""[^\s:/@"'<>]{1,64}"""
_PARTS = {
    "assign": r"(?i:(?:password|passwd|secret|token|api_?key)" + _VALUE + r"[A-Za-z0-9+/_.=-]{6,})",
    "access": ACCESS,
    "hex": HEX,
    "weak_id": r"(?<=://)" + _USER + r"(?=:[^\s/@\"'<>]{3,128}@)|(?<![A-Za-z0-9])A[KS]IA[A-Z0-9]{4,15}(?![A-Z0-9])|(?i:(?<![a-z0-9])(?<!secret_)(?:user(?:_?name)?|login|client_?id|account(?:_?id)?|access_?key(?:_?id)?)" + _VALUE + r"[A-Za-z0-9+/_.@-]{3,})",
    "weak_secret": r"(?<=:)(?<=://" + _USER + r":)[^\s/@\"'<>]{3,128}(?=@)|(?i:(?<![a-z0-9])(?:pwd|pass|pass_?phrase|credentials?|auth|private_?key|secret_?(?:access_?)?key)" + _VALUE + r"[A-Za-z0-9+/_.=-]{4,})"
    + r"|(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/]{0,39}[0-9])(?=[a-z0-9+/]{0,39}[A-Z])(?=[A-Z0-9+/]{0,39}[a-z])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])"
    + r"|(?<![A-Za-z0-9])(?=[a-f]{0,22}[0-9])(?=[0-9]{0,22}[a-f])[0-9a-f]{16,23}(?![A-Za-z0-9])",
    "endpoint": r"""(?<![A-Za-z0-9])(?i:https?|s3|jdbc:[a-z]{2,12}|postgres|mysql|redis|ftp)://[^\s"'<>]{4,}|(?<![A-Za-z0-9.-])[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}:[0-9]{2,5}(?![0-9])""",
}
BREAK = r"\n[ \t\r]*\n"  # parts neither begin nor end with white space, so breaks between any of them add up
#: The scans for parts beside those of the base kinds; an assignment's parts may start where no base match does.
_SCANS = {"assign_part": "assign", "weak_id": "weak_id", "weak_secret": "weak_secret", "endpoint": "endpoint"}
#: Nothing is linked without an identifier, and each has one of these.
_MAY_LINK = r"[:=]|A[KS]IA"


def _scan(scan: str, pattern: str, when: Column, ok=lambda m: F.lit(True)) -> Column:
    """The matches of one pattern, in order, each with the length of the gap before it."""
    nothing = F.expr("cast(array() as array<struct<scan:string,i:int,gap:int,len:int,ok:boolean,br:int>>)")
    gaps = F.split("_t", pattern, -1)
    found = F.regexp_extract_all("_t", F.lit(pattern), F.lit(0))
    pairs = F.when(when, F.arrays_zip(found.alias("m"), gaps.alias("g"))).otherwise(F.expr("cast(array() as array<struct<m:string,g:string>>)"))
    made = F.transform(
        pairs,
        lambda p, i: F.struct(
            F.lit(scan).alias("scan"),
            i.alias("i"),
            F.length(p["g"]).alias("gap"),
            F.length(p["m"]).alias("len"),
            ok(p["m"]).alias("ok"),
            (F.size(F.split(p["g"], BREAK, -1)) - 1).alias("br"),
        ),
    )
    return F.when(when, F.filter(made, lambda x: x["len"].isNotNull())).otherwise(nothing)  # the last gap has no match


def _linked(rows: DataFrame, reach: int | None) -> DataFrame:
    """rows plus ``by_id`` and ``by_secret``: whether a part of that role is within ``reach`` and neither lies inside the other.

    What starts before a part that is in no other, or ends after it, can't contain it. For a part inside another, those
    count that contain none. An endpoint may contain what it is linked with.
    """
    far, scope, no = W.unboundedPreceding, W.partitionBy("_id", "scope"), F.lit(False)
    from_start, before = scope.orderBy("start").rangeBetween(far, 0), scope.orderBy("start").rangeBetween(far, -1)
    to_start, after = scope.orderBy(F.desc("start")).rangeBetween(far, 0), scope.orderBy(F.desc("end")).rangeBetween(far, -1)
    roles = {"id": ("access", "weak_id"), "secret": ("assign", "hex", "weak_secret")}
    rows = rows.withColumns({f"is_{r}": (F.col("scan") != "assign") & F.col("kind").isin(*kinds) for r, kinds in roles.items()})
    inside = lambda r: F.coalesce(F.max(F.when(F.col(f"is_{r}"), F.col("end"))).over(from_start) >= F.col("end"), no)
    holds = lambda r: F.coalesce(F.min(F.when(F.col(f"is_{r}"), F.col("end"))).over(to_start) <= F.col("end"), no)
    either = lambda f: (F.col("is_id") & f("secret")) | (F.col("is_secret") & f("id"))
    rows = rows.withColumns({"inner": either(inside), "outer": either(holds)})

    def near(role: Column) -> Column:
        last, place = F.max(F.when(role, F.col("end"))).over(before), F.when(role, F.col("start"))
        following = F.when(F.col("kind") == "endpoint", F.min(place).over(to_start)).otherwise(F.min(place).over(after))
        if reach is None:
            return last.isNotNull() | following.isNotNull()
        return F.coalesce(F.col("start") - last <= reach, no) | F.coalesce(following - F.col("end") <= reach, no)

    return rows.withColumns({f"by_{r}": F.when(F.col("inner"), near(F.col(f"is_{r}") & ~F.col("outer"))).otherwise(near(F.col(f"is_{r}"))) for r in roles})


def with_spans(docs: DataFrame, reach: int | None = REACH, carry: list[str] | None = None) -> DataFrame:
    """docs' columns (or those in ``carry``, so that whole texts need not be shuffled) plus ``_spans`` (in place of a column of that name): array of (start, end, kind, base) by start, then kind as in KINDS.

    Places are code points, ends exclusive. Null and empty texts have no spans; equal rows each get theirs;
    extra columns are carried along (once per row).
    """
    found = _find(docs, reach, carry)
    spans = F.transform("_spans", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), x["base"].alias("base")))
    return found.select(*[F.col(f"_row.`{c}`").alias(c) for c in carry or docs.columns if c != "_spans"], spans.alias("_spans"))


def _find(docs: DataFrame, reach: int | None, carry: list[str] | None = None, merge: bool = False) -> DataFrame:
    """(_row, _spans): docs' columns stay in a struct, so no name of theirs can clash. With ``merge`` a span's ``seen`` is the largest end of the spans before it."""
    kept = F.struct(*[F.col(f"`{c}`") for c in carry or docs.columns])
    d = docs.select(kept.alias("_row"), F.monotonically_increasing_id().alias("_id"), text_of().alias("_t"))
    signed = F.contains("_t", F.lit("=")) | F.contains("_t", F.lit(":"))
    d = d.withColumn(
        "_all",
        F.concat(
            _scan("assign", ASSIGN, signed, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 6),
            _scan("access", ACCESS, F.contains("_t", F.lit("AKIA"))),
            _scan("hex", HEX, F.col("_t").rlike(HEX)),
            *[_scan(scan, _PARTS[kind], F.col("_t").rlike(_MAY_LINK)) for scan, kind in _SCANS.items()],
        ),
    )
    kind = F.coalesce(F.create_map(*[F.lit(x) for pair in _SCANS.items() for x in pair])[F.col("x.scan")], F.col("x.scan"))
    rows = d.select("_id", "_row", F.posexplode_outer("_all").alias("_n", "x"))
    rows = rows.select("_id", F.when(F.coalesce("_n", F.lit(0)) == 0, F.col("_row")).alias("_row"), kind.alias("kind"), "x.scan", "x.i", "x.gap", "x.len", "x.ok", "x.br")
    rows = rows.repartition("_id")
    order = W.partitionBy("_id", "scan").orderBy("i")
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(order)).withColumn("start", F.col("end") - F.col("len"))
    rows = _linked(rows.withColumn("scope", F.sum("br").over(order)), reach)
    base = F.col("scan").isin(*KINDS[:3]) & F.col("ok")
    linked = (
        ((F.col("kind") == "weak_id") & F.col("by_secret"))
        | ((F.col("kind") == "weak_secret") & F.col("by_id"))
        | ((F.col("kind") == "endpoint") & F.col("by_id") & F.col("by_secret"))
    )
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int")
    rows = rows.withColumn("found", F.coalesce(base | linked, F.lit(False))).withColumn("rank", rank)
    if merge:  # how far the spans before reach
        rows = rows.withColumn("seen", F.max(F.when(F.col("found"), F.col("end"))).over(W.partitionBy("_id").orderBy("start", "rank").rowsBetween(W.unboundedPreceding, -1)))
    else:
        rows = rows.withColumn("seen", F.lit(None).cast("long"))
    span = F.when(F.col("found"), F.struct("start", "rank", "end", "kind", base.alias("base"), F.coalesce("seen", F.lit(0)).alias("seen")))
    out = rows.groupBy("_id").agg(F.first("_row", ignorenulls=True).alias("_row"), F.sort_array(F.collect_list(span)).alias("s"))
    return out.select("_row", F.transform("s", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), x["base"].alias("base"), x["seen"].alias("seen"))).alias("_spans"))


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, reach: int | None = REACH) -> DataFrame:
    """One row per row of docs: doc_id, counts of base kinds, base_sha256, spans, n_linked (spans that linking added)."""
    d = with_spans(docs, reach, ["doc_id"])
    s, base = F.col("_spans"), F.filter("_spans", lambda x: x["base"])
    count = lambda kind: F.size(F.filter(s, lambda x: x["base"] & (x["kind"] == kind))).cast("long")
    return d.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(_written(base), 256).alias("base_sha256"),
        _written(s).alias("spans"),
        F.size(F.filter(s, lambda x: ~x["base"])).cast("long").alias("n_linked"),
    )


def redact(docs: DataFrame, reach: int | None = REACH, mark: str = "[SECRET]") -> DataFrame:
    """docs with every span (overlapping ones merged) replaced by ``mark``; same columns, ``n_chars`` follows the text.

    Rows without a candidate pass unchanged and unshuffled; a null text stays null, an empty one empty. Repeated rows and rows with one or no
    doc_id each have their own text. A text is cut once at its spans, at fixed four bytes a code point, so long ones take time in
    proportion to their length. An empty docs gives no rows.
    """
    may = F.coalesce(F.col("text").rlike(f"{_MAY_LINK}|{HEX}"), F.lit(False))
    found = _find(docs.where(may), reach, merge=True)
    text = F.col("_row.text")
    wide = F.encode(text, "UTF-32")
    piece = lambda at, to: F.decode(F.substring(wide, at * 4 + 1, (to - at) * 4), "UTF-32")
    opening = F.filter("_spans", lambda x: x["start"] >= x["seen"])  # a span that begins inside another adds nothing
    before = F.transform(opening, lambda x: piece(x["seen"].cast("int"), x["start"].cast("int")))
    last = F.array_max(F.transform("_spans", lambda x: x["end"])).cast("int")
    pieces = F.concat(before, F.array(piece(last, F.length(text))))
    found = found.withColumn("_new", F.when(F.size("_spans") > 0, F.array_join(pieces, mark)).otherwise(text))
    own = {c: F.col(f"_row.`{c}`") for c in docs.columns} | {"text": F.col("_new")}
    if "n_chars" in own:
        own["n_chars"] = F.when(F.size("_spans") > 0, F.length("_new").cast(docs.schema["n_chars"].dataType)).otherwise(own["n_chars"])
    return docs.where(~may).unionByName(found.select(*[c.alias(name) for name, c in own.items()]))
