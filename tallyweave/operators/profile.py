"""Column profiles: missing and distinct counts, numeric statistics, most frequent values, a preview.

All columns are turned into rows (column, value) once; one aggregation by value then serves distinct counts and most
frequent values of all columns, where a count of distinct values for each column would read or expand the table anew.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUANTILES = (0.25, 0.5, 0.75)
#: Bins of a pass that narrows a quantile down.
BINS = 1024


def _columns(df: DataFrame, columns: list[str] | None, numeric: bool | None = None) -> list[str]:
    wanted = columns or df.columns
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return [c for c in wanted if numeric is None or isinstance(kinds[c], T.NumericType) == numeric]


def value_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column_name, value (as text, null for missing), n."""
    names = _columns(df, columns)
    pairs = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("value")) for c in names))
    return df.select(F.explode(pairs).alias("p")).groupBy("p.column_name", "p.value").agg(F.count("*").alias("n"))


def missing_distinct(df: DataFrame, columns: list[str] | None = None, approximate: bool = False) -> DataFrame:
    """column_name, n_rows, missing_count, missing_pct, distinct_count, cardinality_pct of each column.

    Percentages of an empty table are 0. `approximate` counts distinct values by sketches, in one pass without a shuffle
    of values.
    """
    if approximate:
        names = _columns(df, columns)
        sums = df.agg(F.count("*").alias("n"), *(F.count_if(F.col(f"`{c}`").isNull()).alias(f"m{i}") for i, c in enumerate(names)), *(F.approx_count_distinct(f"`{c}`").alias(f"d{i}") for i, c in enumerate(names)))
        rows = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col("n").alias("n_rows"), F.col(f"m{i}").alias("missing_count"), F.col(f"d{i}").alias("distinct_count")) for i, c in enumerate(names)))
        counted = sums.select(F.inline(rows))
    else:
        counted = value_counts(df, columns).groupBy("column_name").agg(
            F.sum("n").alias("n_rows"), F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("missing_count"), F.count("value").alias("distinct_count")
        )
    pct = lambda c: F.round(F.col(c).cast("double") * 100 / F.nullif(F.col("n_rows"), F.lit(0)), 4)
    return counted.select("column_name", "n_rows", "missing_count", F.coalesce(pct("missing_count"), F.lit(0.0)).alias("missing_pct"), "distinct_count", F.coalesce(pct("distinct_count"), F.lit(0.0)).alias("cardinality_pct"))


def _narrowed(values: DataFrame, intervals: set[tuple[int, float, float]]) -> dict[tuple[int, float, float], list]:
    """For each interval (column, low, high) its bins in order, as (values in it, least, largest)."""
    told = values.sparkSession.createDataFrame(sorted(intervals), "k int, low double, high double")
    inside = values.join(F.broadcast(told), "k").where("v >= low and v <= high")
    bins = F.least(F.floor((F.col("v") / BINS - F.col("low") / BINS) / (F.col("high") / BINS - F.col("low") / BINS) * BINS), F.lit(BINS - 1))
    found: dict[tuple[int, float, float], list] = {}
    for r in inside.groupBy("k", "low", "high", bins.alias("bin")).agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most")).orderBy("k", "low", "high", "bin").collect():
        found.setdefault((r.k, r.low, r.high), []).append((r.n, r.least, r.most))
    return found


def _ranked(values: DataFrame, spans: dict[int, tuple[float, float]], ranks: set[tuple[int, int]]) -> dict[tuple[int, int], float]:
    """The value of each rank (column, place from 0) among rows (k, v), by histograms that narrow down until a bin has one value.

    A pass counts by column and bin, so neither a task nor the driver holds a column's values.
    """
    at = {(k, place): (*spans[k], place) for k, place in ranks}
    done: dict[tuple[int, int], float] = {}
    while at:
        done |= {key: low for key, (low, high, _) in at.items() if low == high}
        at = {key: x for key, x in at.items() if key not in done}
        if not at:
            break
        bins = _narrowed(values, {(k, low, high) for (k, _), (low, high, _) in at.items()})
        for (k, place), (low, high, left) in at.items():
            for n, least, most in bins[k, low, high]:
                if left < n:
                    at[k, place] = (least, most, left)
                    break
                left -= n
    return done


def quantiles(df: DataFrame, names: list[str], shares: tuple[float, ...] = QUANTILES) -> list[list[float | None]]:
    """For each numeric column its quantiles, interpolated between neighbours; those of no value are None. NaN and infinite values don't count."""
    value = lambda c: F.col(f"`{c}`").cast("double")
    finite = lambda c: F.abs(value(c)) < float("inf")  # noqa: E731  false for NaN, which is larger than all
    sums = df.agg(*(e.alias(f"{n}{i}") for i, c in enumerate(names) for n, e in (("n", F.count_if(finite(c))), ("low", F.min(F.when(finite(c), value(c)))), ("high", F.max(F.when(finite(c), value(c))))))).first()
    each = F.array(*(F.struct(F.lit(i).alias("k"), F.when(finite(c), value(c)).alias("v")) for i, c in enumerate(names)))
    values = df.select(F.explode(each).alias("x")).select("x.*").where("v is not null")
    places = {(i, p): p * (sums[f"n{i}"] - 1) for i in range(len(names)) for p in shares if sums[f"n{i}"]}
    ranks = {(i, r) for (i, _), x in places.items() for r in (math.floor(x), math.ceil(x))}
    known = _ranked(values, {i: (sums[f"low{i}"], sums[f"high{i}"]) for i, _ in ranks}, ranks)

    def between(i: int, p: float) -> float | None:
        if (i, p) not in places:
            return None
        x = places[i, p]
        low, high = known[i, math.floor(x)], known[i, math.ceil(x)]
        return low + (high - low) * (x - math.floor(x))

    return [[between(i, p) for p in shares] for i in range(len(names))]


def numeric_stats(df: DataFrame, columns: list[str] | None = None, approximate: bool = False) -> DataFrame:
    """column_name, min, max, mean, std (of a sample), median, p25, p75, to 4 places, of each numeric column.

    Quantiles interpolate between values and are exact, by a few passes of bounded memory; `approximate` takes them from
    sketches of fixed size in the one pass that the other statistics need.
    """
    names = _columns(df, columns, numeric=True)
    value = lambda c: F.col(f"`{c}`").cast("double")
    if approximate:
        cut = lambda i, c: F.percentile_approx(value(c), list(QUANTILES), 10_000)
    else:
        known = quantiles(df, names)
        cut = lambda i, c: F.array(*(F.lit(q).cast("double") for q in known[i]))
    sums = df.agg(*(e.alias(f"{k}{i}") for i, c in enumerate(names) for k, e in (("min", F.min(value(c))), ("max", F.max(value(c))), ("mean", F.avg(value(c))), ("std", F.stddev_samp(value(c))), *((("q", cut(i, c)),) if approximate else ()))))
    if not approximate:
        sums = sums.select("*", *(cut(i, c).alias(f"q{i}") for i, c in enumerate(names)))
    r = lambda e, n: F.round(e, 4).alias(n)
    rows = F.array(*(F.struct(F.lit(c).alias("column_name"), r(F.col(f"min{i}"), "min"), r(F.col(f"max{i}"), "max"), r(F.col(f"mean{i}"), "mean"), r(F.col(f"std{i}"), "std"), r(F.col(f"q{i}")[1], "median"), r(F.col(f"q{i}")[0], "p25"), r(F.col(f"q{i}")[2], "p75")) for i, c in enumerate(names)))
    return sums.select(F.inline(rows))


def top_values(df: DataFrame, columns: list[str] | None = None, k: int = 5) -> DataFrame:
    """column_name, rank, value, n, pct of the k most frequent values of each column; equal counts go by value."""
    counts = value_counts(df, columns)
    total = counts.groupBy("column_name").agg(F.sum("n").alias("n_rows"))
    order = Window.partitionBy("column_name").orderBy(F.desc("n"), "value")
    first = counts.where("value is not null").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return first.join(F.broadcast(total), "column_name").select("column_name", "rank", "value", "n", F.round(F.col("n").cast("double") * 100 / F.col("n_rows"), 2).alias("pct"))


def preview(df: DataFrame, n: int = 10, order_by: list[str] | None = None) -> DataFrame:
    """The first n rows, in an order where one is given."""
    return (df.orderBy(*order_by) if order_by else df).limit(n)


def profile(df: DataFrame, top: int = 5, sample: int = 10) -> dict:
    """The whole profile as a small nested dict, as reports take it: one entry for each column."""
    kinds = dict(df.dtypes)
    base = {r.column_name: r for r in missing_distinct(df).collect()}
    numbers = {r.column_name: r.asDict() for r in numeric_stats(df).collect()} if _columns(df, None, True) else {}
    words: dict[str, list] = {}
    others = _columns(df, None, numeric=False)
    for r in sorted(top_values(df, others, top).collect(), key=lambda r: r["rank"]) if others else []:
        words.setdefault(r.column_name, []).append({"value": r.value, "count": r.n, "pct": r.pct})
    n_rows = max((r.n_rows for r in base.values()), default=0)
    missing = sum(r.missing_count for r in base.values())
    columns = []
    for c in df.columns:
        r = base.get(c)
        stats = {k: v for k, v in numbers[c].items() if k != "column_name"} if c in numbers else None
        columns.append({"name": c, "type": kinds[c], "missing_count": r.missing_count if r else 0, "missing_pct": r.missing_pct if r else 0.0, "distinct_count": r.distinct_count if r else 0, "cardinality_pct": r.cardinality_pct if r else 0.0, "numeric_stats": stats, "top_categories": None if stats else words.get(c, [])})
    return {"total_rows": n_rows, "total_cols": len(df.columns), "total_missing_pct": round(100 * missing / max(1, n_rows * len(df.columns)), 2), "column_stats": columns, "column_names": df.columns, "sample_records": [r.asDict() for r in preview(df, sample).collect()]}
