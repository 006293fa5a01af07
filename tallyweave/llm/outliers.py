"""Quality rules in expressions alone: counts of words, symbols and repeats, and robust multivariate outliers.

Each document that passes the base rules has a vector of transformed statistics. Per language and source, the minimum
covariance determinant estimate is sought by concentration steps: keep the share H of documents that lie nearest, take
their mean and covariance, and again until nothing changes. The steps set out from three estimates that need no chance:
medians and quartiles, the plain mean and covariance, and medians with the correlations of vectors drawn in by a
hyperbolic tangent. Of the three ends, that with the least determinant holds. Distances fall into fine bins of their
logarithm, and the bin in which the share ends counts in part; so a step sums moments by group, start and bin, reads the
vectors once, gives the same in any order of rows, and no task holds a group. A document whose Mahalanobis distance is
beyond the chi-square quantile is rejected.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.llm import common

FEATURES = ("word_length", "symbols", "dup_lines", "repeats")
D = len(FEATURES)
#: Share of a group that determines the estimate, and bins for each factor e of the squared distance.
H, BINS = 0.75, 64
#: Steps end once no group's log determinant changes by more, or after so many, which none of our data came near.
SETTLED, MOST_STEPS = 1e-9, 100
#: The estimate is defined for groups of more than 5 documents a dimension, as the literature asks for; a smaller group
#: takes the estimate of its language, a smaller language that of all documents.
LEAST_GROUP = 5 * D
#: Probability that a normal vector lies beyond the cut.
TAIL = 1e-6
#: The least standard deviation of each feature given those before it. Most documents have no symbols and no repeats, so the
#: nearest share often lies in a plane and its covariance is singular; there, and only there, this stands for the width.
FLOOR = (0.05, 0.06, 0.06, 0.10)
#: Medians are found to this part of the floor.
FINE = 16
#: One repeated line is found in clean text, and in a text of a few lines it is a large share: it isn't counted, and the
#: others are a share of the lines and so many more.
ONE_LINE, MORE_LINES = 1, 20
#: Groups are counted before their estimates are broadcast; more than so many are joined by a shuffle.
BROADCAST_GROUPS = 50_000


def _chi_square_below(x: float, d: int) -> float:
    """Distribution function for an even number of degrees of freedom."""
    term = total = 1.0
    for k in range(1, d // 2):
        term *= x / 2 / k
        total += term
    return 1 - math.exp(-x / 2) * total


def _quantile(p: float, d: int) -> float:
    low, high = 0.0, 1e3
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi_square_below(mid, d) < p else (low, mid)
    return low


#: The covariance of the nearest share H of a normal sample is too small by this factor.
CONSISTENCY = H / _chi_square_below(_quantile(H, D), D + 2)
CUT = _quantile(1 - TAIL, D)


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words of each row."""
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(lang_col).cast("string").alias("lang"),
        F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    rows = rows.select(
        "doc_id",
        "lang",
        "source",
        F.filter(F.split("text", f"[{common.SPACES}]+"), lambda w: w != "").alias("words"),
        F.filter(F.split("text", "\n"), lambda line: line.rlike(common.WORD)).alias("lines"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).alias("n_symbols"),
    )
    n = F.size("words")
    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)))).otherwise(F.array().cast("array<bigint>"))
    rows = rows.select("*", windows.alias("windows"))
    placed = F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.select("*", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), placed).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")).alias("placed"))

    def twice(x: Column, k: Column) -> Column:
        beside = lambda j: F.coalesce(F.get("placed", j)["h"] == x["h"], F.lit(False))
        return beside(k - 1) | beside(k + 1)

    rows = rows.select("*", F.sort_array(F.transform(F.filter("placed", twice), lambda x: x["i"])).alias("again"))
    covered = F.aggregate(
        "again",
        F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda s, i: F.struct(i.alias("last"), (s["n"] + F.least(F.lit(3), i - s["last"])).alias("n")),
        lambda s: s["n"],
    )
    return rows.select(
        "doc_id",
        "lang",
        "source",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.col("n_symbols").cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
    )


def vectors(rows: DataFrame) -> DataFrame:
    """base_failed and the transformed vector beside each row of statistics; the vector means something where base_failed is false."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    lines = F.greatest(F.col("n_lines"), F.lit(1)).cast("double")
    return rows.select(
        "*",
        ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n).alias("word_length"),
        F.log1p(F.col("n_symbols") / n).alias("symbols"),
        F.sqrt(F.greatest(F.col("n_dup_lines") - ONE_LINE, F.lit(0)) / (lines + MORE_LINES)).alias("dup_lines"),
        F.sqrt(F.col("n_repeat_words") / n).alias("repeats"),
    )


def _key(*columns: str) -> Column:
    """A string that is another for any other values, nulls included."""
    return F.concat(*(F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c)), F.lit("-")) for c in columns))


def _small(groups: DataFrame, bounded: bool) -> DataFrame:
    return F.broadcast(groups) if bounded else groups


def scoped(rows: DataFrame) -> tuple[DataFrame, bool]:
    """`scope`, the group whose estimate holds for a row; and whether there are few enough groups to broadcast."""
    passing = rows.where(~F.col("base_failed"))
    counts = passing.groupBy(_key("lang", "source").alias("pair"), _key("lang").alias("own")).agg(F.count("*").alias("n"))
    bounded = counts.count() <= BROADCAST_GROUPS
    by_lang = counts.groupBy(F.col("own").alias("lang_key")).agg(F.sum("n").alias("n_lang"))
    chosen = counts.join(_small(by_lang, bounded), F.col("own") == F.col("lang_key"))
    scope = F.when(F.col("n") >= LEAST_GROUP, F.concat(F.lit("pair "), "pair")).when(F.col("n_lang") >= LEAST_GROUP, F.concat(F.lit("lang "), "own")).otherwise("all")
    chosen = chosen.select("pair", scope.alias("scope"))
    keyed = passing.withColumn("key", _key("lang", "source"))
    return keyed.join(_small(chosen, bounded), keyed["key"] == chosen["pair"]).drop("key", "pair"), bounded


def _whole(rows: DataFrame) -> DataFrame:
    """Each row under the scopes it informs: its pair, its language and all."""
    scopes = F.array(F.concat(F.lit("pair "), _key("lang", "source")), F.concat(F.lit("lang "), _key("lang")), F.lit("all"))
    return rows.select(*FEATURES, F.explode(scopes).alias("scope"))


def _distance(center: list[Column], lower: list[list[Column]]) -> Column:
    """The squared Mahalanobis distance by forward substitution in the Cholesky factor."""
    y: list[Column] = []
    for i, f in enumerate(FEATURES):
        rest = F.col(f) - center[i]
        for j in range(i):
            rest = rest - lower[i][j] * F.col(f"y{j}")
        y.append((rest / lower[i][i]).alias(f"y{i}"))
    return y


def distances(rows: DataFrame, estimate: DataFrame, bounded: bool, *more: str) -> DataFrame:
    """`d2` and the columns `more` of the estimate beside each row of its scope."""
    out = rows.join(_small(estimate, bounded), "scope")
    keep = [*rows.columns, *more]
    center = [F.col(f"m{i}") for i in range(D)]
    lower = [[F.col(f"l{i}{j}") for j in range(i + 1)] for i in range(D)]
    y = _distance(center, lower)
    for i in range(D):
        out = out.withColumn(f"y{i}", y[i])
    return out.select(*keep, sum((F.col(f"y{i}") * F.col(f"y{i}") for i in range(1, D)), F.col("y0") * F.col("y0")).alias("d2"))


PAIRS = [(i, j) for i in range(D) for j in range(i + 1)]
_MEAN, _LOWER = [f"m{i}" for i in range(D)], [f"l{i}{j}" for i, j in PAIRS]


def _factored(rows: DataFrame) -> DataFrame:
    """The Cholesky factor l00.. of the covariances c00.., and `width`, the logarithm of the root of the determinant.

    A pivot below the floor is set to it; any other stays as it is.
    """
    for i, j in PAIRS:
        own = F.col(f"c{i}{j}")
        for k in range(j):
            own = own - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        rows = rows.withColumn(f"l{i}{j}", F.sqrt(F.greatest(own, F.lit(FLOOR[i] ** 2))) if i == j else own / F.col(f"l{j}{j}"))
    return rows.withColumn("width", sum((F.log(f"l{i}{i}") for i in range(1, D)), F.log("l00")))


def _covariance(c: dict[tuple[int, int], Column]) -> list[Column]:
    return [c[p].alias(f"c{p[0]}{p[1]}") for p in PAIRS]


def _quartiles(rows: DataFrame) -> DataFrame:
    """scope, m0.. (medians) and s0.. (quartile widths as standard deviations, FLOOR at least), from counts by bin."""
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("feature"), F.floor(F.col(f) * (FINE / FLOOR[i])).alias("bin")) for i, f in enumerate(FEATURES))))
    counts = rows.select("scope", each.alias("x")).groupBy("scope", "x.feature", "x.bin").agg(F.count("*").alias("n"))
    w = Window.partitionBy("scope", "feature")
    placed = counts.withColumn("upto", F.sum("n").over(w.orderBy("bin"))).withColumn("all", F.sum("n").over(w))
    at = lambda share: F.min(F.when(F.col("upto") >= share * F.col("all"), F.col("bin"))) + 0.5
    found = placed.groupBy("scope", "feature").agg(at(0.25).alias("low"), at(0.5).alias("mid"), at(0.75).alias("high"))
    pick = lambda i, c: F.max(F.when(F.col("feature") == i, c)) * (FLOOR[i] / FINE)
    wide = lambda i: F.greatest(pick(i, F.col("high") - F.col("low")) / 1.349, F.lit(FLOOR[i]))
    return found.groupBy("scope").agg(*(pick(i, F.col("mid")).alias(f"m{i}") for i in range(D)), *(wide(i).alias(f"s{i}") for i in range(D)))


def _starts(rows: DataFrame, bounded: bool) -> DataFrame:
    """Three estimates of each scope, numbered by `start`."""
    middle = common.checkpoint(_quartiles(rows))
    by_quartiles = middle.select("scope", F.lit(0).alias("start"), *_MEAN, *_covariance({(i, j): F.col(f"s{i}") * F.col(f"s{i}") if i == j else F.lit(0.0) for i, j in PAIRS}))
    plain = rows.groupBy("scope").agg(*(F.avg(f).alias(f"m{i}") for i, f in enumerate(FEATURES)), *_covariance({(i, j): F.covar_pop(FEATURES[i], FEATURES[j]) for i, j in PAIRS}))
    drawn = rows.join(_small(middle, bounded), "scope").withColumns({f"t{i}": F.tanh((F.col(f) - F.col(f"m{i}")) / F.col(f"s{i}")) for i, f in enumerate(FEATURES)})
    related = drawn.groupBy("scope", *_MEAN, *(f"s{i}" for i in range(D))).agg(*_covariance({(i, j): F.covar_pop(f"t{i}", f"t{j}") for i, j in PAIRS}))
    deviation = lambda i: F.sqrt(F.greatest(F.col(f"c{i}{i}"), F.lit(1e-12)))
    by_tangent = related.select("scope", F.lit(2).alias("start"), *_MEAN, *_covariance({(i, j): F.col(f"s{i}") * F.col(f"s{j}") * (F.lit(1.0) if i == j else F.col(f"c{i}{j}") / (deviation(i) * deviation(j))) for i, j in PAIRS}))
    every = by_quartiles.unionByName(plain.withColumn("start", F.lit(1))).unionByName(by_tangent)
    return common.checkpoint(_factored(every).select("scope", "start", *_MEAN, *_LOWER, "width"))


def _step(rows: DataFrame, estimate: DataFrame, bounded: bool) -> DataFrame:
    """One concentration step from each start: mean and factor of the nearest share H, and `before`, the width until now."""
    near = distances(rows, estimate, bounded, "start", "width")
    far = F.greatest(F.lit(-40 * BINS), F.least(F.lit(40 * BINS), F.ceil(BINS * F.log(F.greatest(F.col("d2"), F.lit(1e-18)))))).cast("int")
    sums = [F.sum(f).alias(f"s{i}") for i, f in enumerate(FEATURES)] + [F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"p{i}{j}") for i, j in PAIRS]
    group = ("scope", "start", "width")
    binned = near.groupBy(*group, far.alias("bin")).agg(F.count("*").alias("n"), *sums)
    w = Window.partitionBy("scope", "start")
    wanted = F.ceil(H * F.sum("n").over(w)) - F.sum("n").over(w.orderBy("bin")) + F.col("n")
    share = F.least(F.lit(1.0), wanted / F.col("n"))
    nearest = binned.withColumn("share", share).where("share > 0")
    moments = nearest.groupBy(*group).agg(F.sum(F.col("share") * F.col("n")).alias("n"), *(F.sum(F.col("share") * F.col(c)).alias(c) for c in [f"s{i}" for i in range(D)] + [f"p{i}{j}" for i, j in PAIRS]))
    mean = [F.col(f"s{i}") / F.col("n") for i in range(D)]
    spread = {(i, j): CONSISTENCY * (F.col(f"p{i}{j}") / F.col("n") - mean[i] * mean[j]) for i, j in PAIRS}
    out = moments.select("scope", "start", F.col("width").alias("before"), *(m.alias(f"m{i}") for i, m in enumerate(mean)), *_covariance(spread))
    return _factored(out).select("scope", "start", *_MEAN, *_LOWER, "width", "before")


def estimates(rows: DataFrame, bounded: bool) -> DataFrame:
    """The estimate of each scope in use: mean m0.. and Cholesky factor l00.. of the covariance."""
    wanted = rows.select("scope").distinct()
    informing = common.checkpoint(_whole(rows.drop("scope")).join(_small(wanted, bounded), "scope", "left_semi"))
    estimate = _starts(informing, bounded)
    for _ in range(MOST_STEPS):
        estimate = common.checkpoint(_step(informing, estimate.drop("before"), bounded))
        if not estimate.where(F.abs(F.col("width") - F.col("before")) > SETTLED).limit(1).count():
            break
    best = estimate.groupBy("scope").agg(F.min(F.struct("width", "start", *_MEAN, *_LOWER)).alias("best"))
    return best.select("scope", *(f"best.{c}" for c in _MEAN + _LOWER))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and d2 of each row.

    A null text has no words and so fails the base rules. Null languages and sources are groups of their own. Repeated
    rows count as often as they stand there, and each gets its own result. An empty table gives an empty result. A text
    is taken whole; its words and windows meet in its own row. d2 is null where the base rules fail.
    """
    rows = common.checkpoint(vectors(statistics(docs, id_col, text_col, lang_col, source_col)))
    within, bounded = scoped(rows)
    estimate = common.checkpoint(estimates(within, bounded))
    judged = distances(within, estimate, bounded).withColumn("kept", F.col("d2") <= CUT)
    failed = rows.where("base_failed").withColumns({"scope": F.lit(None).cast("string"), "d2": F.lit(None).cast("double"), "kept": F.lit(False)})
    return judged.unionByName(failed).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "d2")
