"""Secret scans in expressions alone: plain patterns, and multipart credentials linked by an interval join within scopes.

Plain (base) spans are found by three patterns. Beside them stand weak candidates, parts of a credential that mean little
alone: a named identifier, a long random string or a short assigned value, an endpoint. The spans of a text are joined
where the gap between two is at most `scope` code points, and a weak candidate is reported only when its complement is
there: an identifier with a secret, a secret with an identifier or an endpoint, an endpoint with both.

The join sweeps over a text's spans in the order of their starts. Of the spans that begin no later than a given one, the
one that reaches furthest says whether any comes near; of those that begin no earlier, the one that begins first. Both
are running extremes, so a text with n spans costs n log n. Spans are dealt by text, and no text leaves its task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The three base patterns and their least lengths.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "[0-9a-f]{16,}"
LEAST_VALUE = 12

WEAK_ID = r"""(?i:(access_?key_?id|client_?id|key_?id|tenant_?id|account|user_?name|user|login))["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@+-]{3,})"""
WEAK_SECRET = "[A-Za-z0-9+/_=-]{32,}"
LEAST_WEAK_VALUE = 6
ENDPOINT = r"""(?i:https?|wss?|postgresql|postgres|mysql|mongodb|redis|amqps?|s3)://[^\x00-\x20"'<>]+"""
SCOPE = 200

#: In the order in which kinds at the same start are listed.
KINDS = ("assign", "access", "hex", "link_id", "link_secret", "link_endpoint")
BASE, SECRETS, IDENTIFIERS, ENDPOINTS = (0, 1, 2), (0, 2, 4), (1, 3), (5,)
#: A row for each text, so that one without a span stays; and matches that are no span, kept for the places of the others.
_TEXT, _NO_SPAN = 9, -1
_PIECES = "array<struct<family:int,nth:int,gap:int,size:int,kind:int>>"


def _pieces(text: Column, pattern: str, family: int, kinds: Column) -> Column:
    """All leftmost matches of a pattern: what lies before each since the last, its size and its kind, by their order."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches))
    zipped = F.arrays_zip(between.alias("before"), matches.alias("match"), kinds.alias("kind"))
    made = F.transform(zipped, lambda z, i: F.struct(F.lit(family).alias("family"), i.alias("nth"), F.length(z["before"]).alias("gap"), F.length(z["match"]).alias("size"), z["kind"].alias("kind")))
    return F.when(text.rlike(pattern), made).otherwise(F.array()).cast(_PIECES)


def _all(text: Column, pattern: str, kind: int) -> Column:
    """The same kind for each match."""
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.lit(kind))


def _assigned(text: Column) -> Column:
    """An assignment is base where its value is long, a weak secret where it is short."""
    size = lambda v: F.when(F.length(v) >= LEAST_VALUE, 0).when(F.length(v) >= LEAST_WEAK_VALUE, 4).otherwise(_NO_SPAN)
    return F.transform(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), size)


def _random(text: Column) -> Column:
    """A random string has digits and letters, and isn't hexadecimal alone, which the base has."""
    mixed = lambda m: m.rlike("[0-9]") & m.rlike("[A-Za-z]") & ~m.rlike("^[0-9a-f]+$")
    return F.transform(F.regexp_extract_all(text, F.lit(WEAK_SECRET), F.lit(0)), lambda m: F.when(mixed(m), 4).otherwise(_NO_SPAN))


def _meets(kinds: tuple[int, ...], gap: int) -> Column:
    """Whether a span of the kinds lies no further than `gap` from the row's; -1 asks for one that overlaps it."""
    text = Window.partitionBy("rid")
    upto = text.orderBy("start").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    from_ = text.orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    own = F.col("kind").isin(*kinds)
    reaches = F.max(F.when(own, F.col("end"))).over(upto) >= F.col("start") - gap
    begins = F.min(F.when(own, F.col("start"))).over(from_) <= F.col("end") + gap
    return F.coalesce(reaches, F.lit(False)) | F.coalesce(begins, F.lit(False))


def _listed(spans: Column) -> Column:
    """kind:start:end of spans by start, then kind, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def spans(docs: DataFrame, scope: int = SCOPE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """rid (a number for each row), doc_id, start, end, kind of each span of each row, linked ones included; and a row of
    kind 9 for each text."""
    text = F.col("text")
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    rows = rows.select(
        "*",
        _pieces(text, ASSIGN, 0, _assigned(text)).alias("assign"),
        _pieces(text, ACCESS, 1, _all(text, ACCESS, 1)).alias("access"),
        _pieces(text, HEX, 2, _all(text, HEX, 2)).alias("hex"),
        _pieces(text, WEAK_SECRET, 3, _random(text)).alias("random"),
    )
    # identifiers and endpoints matter only beside a secret
    real = lambda c: F.exists(c, lambda p: p["kind"] >= 0)
    rows = rows.withColumn("secret", real("assign") | real("hex") | real("random"))
    beside = lambda pattern, family, kind: F.when(F.col("secret"), _pieces(text, pattern, family, _all(text, pattern, kind))).otherwise(F.array()).cast(_PIECES)
    whole = F.array(F.struct(F.lit(6).alias("family"), F.lit(0).alias("nth"), F.lit(0).alias("gap"), F.lit(0).alias("size"), F.lit(_TEXT).alias("kind"))).cast(_PIECES)
    every = F.concat(whole, "assign", "access", "hex", "random", beside(WEAK_ID, 4, 3), beside(ENDPOINT, 5, 5))
    pieces = rows.select("rid", "doc_id", F.explode(every).alias("p")).select("rid", "doc_id", "p.*").repartition("rid")
    end = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy("rid", "family").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = pieces.withColumn("end", end.cast("int")).where(F.col("kind") != _NO_SPAN).select("rid", "doc_id", "family", (F.col("end") - F.col("size")).alias("start"), "end", "kind")
    weak = F.col("family").isin(3, 4)
    apart = found.withColumn("over", _meets(BASE, -1)).where(~(weak & F.col("over"))).drop("over", "family")
    near = apart.withColumns({"by_secret": _meets(SECRETS, scope), "by_id": _meets(IDENTIFIERS, scope), "by_endpoint": _meets(ENDPOINTS, scope)})
    kind = F.col("kind")
    linked = F.when(kind == 3, F.col("by_secret")).when(kind == 4, F.col("by_id") | F.col("by_endpoint")).when(kind == 5, F.col("by_id") & F.col("by_secret")).otherwise(True)
    return near.where(linked).select("rid", "doc_id", "start", "end", "kind")


def scan(docs: DataFrame, scope: int = SCOPE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked and linked (the added spans) of each row.

    A null text is empty and has no spans. Ids may be null or repeated; each row, repeated ones too, gets its own result.
    A text is read whole, however long, and its spans meet in one task.
    """
    kind = F.col("kind")
    one = F.struct("start", "kind", "end")
    some = lambda which: F.collect_list(F.when(which, one))
    number = lambda which: F.count(F.when(which, 1)).cast("long")
    is_base, is_linked = kind.isin(*BASE), kind.isin(3, 4, 5)
    rows = spans(docs, scope, id_col, text_col).groupBy("rid", "doc_id").agg(
        *(number(kind == k).alias(f"n_{KINDS[k]}") for k in BASE), some(is_base).alias("base"), some(is_linked).alias("links"), number(is_linked).alias("n_linked")
    )
    return rows.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _listed(F.concat("base", "links")).alias("spans"), "n_linked", _listed(F.col("links")).alias("linked"),
    )
