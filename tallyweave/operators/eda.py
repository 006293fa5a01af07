"""Exploratory queries on record tables (entity_id, business_name, business_address, country); each is one pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEVANAGARI, LATIN = "[\\u0900-\\u097F]", "[a-zA-Z]"
#: Legal forms and landmark words that are counted.
ABBREVIATIONS = ("Corp", "Corporation", "Inc", "Incorporated", "Ltd", "Limited", "Pvt", "Private", "Co", "Company", "Assoc", "Association", "Org", "Organization", "LLC")
LANDMARKS = "Near|Opp|Opposite|Behind|Beside|Adj"


def whole_word(pattern: str) -> str:
    """The pattern in any case, where no ASCII letter, digit or underscore stands beside it."""
    return f"(?i)(?<![A-Za-z0-9_]){pattern}(?![A-Za-z0-9_])"


def share(part: Column, whole: Column, places: int = 2) -> Column:
    """Percent of a whole, null where the whole is 0."""
    return F.round(part.cast("double") * 100 / F.nullif(whole, F.lit(0)), places)


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """table_name and n_rows of each table, in one job."""
    return reduce(DataFrame.unionByName, (df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows") for name, df in tables.items()))


def distribution(df: DataFrame, column: str = "country", missing: str = "MISSING") -> DataFrame:
    """Value, n and percent of all rows; null is shown as `missing` but stays a group of its own."""
    counts = df.groupBy(F.col(column).alias("raw")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select(F.coalesce("raw", F.lit(missing)).alias(column), "n", share(F.col("n"), F.col("total")).alias("pct"))


def missing_fields(df: DataFrame) -> DataFrame:
    """Missing ids, names, addresses and countries."""
    missing = lambda c, n: F.count_if(F.col(c).isNull()).alias(n)
    return df.agg(F.count("*").alias("n_rows"), missing("entity_id", "missing_id"), missing("business_name", "missing_name"), missing("business_address", "missing_addr"), missing("country", "missing_country"))


def null_vs_empty(df: DataFrame) -> DataFrame:
    null = lambda c: F.count_if(F.col(c).isNull())
    empty = lambda c: F.count_if(F.trim(F.col(c)) == "")
    return df.agg(F.count("*").alias("total"), null("business_name").alias("name_null"), empty("business_name").alias("name_empty"), null("business_address").alias("addr_null"), empty("business_address").alias("addr_empty"))


def case_variation(df: DataFrame, column: str = "business_name") -> DataFrame:
    """Lower, upper and mixed case; a text without case is in none of them."""
    c = F.col(column)
    low, up = c == F.lower(c), c == F.upper(c)
    return df.where(c.isNotNull() & (F.trim(c) != "")).agg(F.count("*").alias("total"), F.count_if(low & ~up).alias("lower_cnt"), F.count_if(up & ~low).alias("upper_cnt"), F.count_if(~low & ~up).alias("mixed_cnt"))


def script_classes(df: DataFrame, column: str = "business_name") -> DataFrame:
    c = F.col(column)
    deva, latin = c.rlike(DEVANAGARI), c.rlike(LATIN)
    return df.where(c.isNotNull()).agg(F.count("*").alias("total"), F.count_if(deva & ~latin).alias("pure_devanagari"), F.count_if(deva & latin).alias("mixed_script"), F.count_if(~deva & latin).alias("pure_latin"), F.count_if(~deva & ~latin).alias("other_script"))


def devanagari_in_country(df: DataFrame, country: str = "India") -> DataFrame:
    named = df.where((F.col("country") == country) & F.col("business_name").isNotNull())
    return named.agg(F.count("*").alias("total"), F.count_if(F.col("business_name").rlike(DEVANAGARI)).alias("devanagari_cnt"))


def country_rows(df: DataFrame, country: str = "France", n: int | None = None) -> DataFrame:
    """The records of a country; with n, that many first by id."""
    rows = df.where(F.col("country") == country)
    return rows if n is None else rows.orderBy("entity_id").limit(n)


def punctuation(df: DataFrame, column: str = "business_name") -> DataFrame:
    has = lambda mark: F.contains(F.col(column), F.lit(mark))
    marks = {"has_period": has("."), "has_apostrophe": has("'"), "has_hyphen": has("-"), "has_ampersand": has("&"), "has_slash": has("/") | has("\\"), "has_comma": has(",")}
    return df.where(F.col(column).isNotNull()).agg(F.count("*").alias("total"), *(F.count_if(e).alias(n) for n, e in marks.items()))


def abbreviations(df: DataFrame, column: str = "business_name", words: tuple[str, ...] = ABBREVIATIONS) -> DataFrame:
    """abbreviation, n, pct: names with each word, in any case, all in one pass."""
    sums = df.agg(F.count("*").alias("total"), *(F.count_if(F.col(column).rlike(whole_word(w))).alias(f"n{i}") for i, w in enumerate(words)))
    rows = F.array(*(F.struct(F.lit(w).alias("abbreviation"), F.col(f"n{i}").alias("n"), share(F.col(f"n{i}"), F.col("total")).alias("pct")) for i, w in enumerate(words)))
    return sums.select(F.inline(rows))


def address_patterns(df: DataFrame, column: str = "business_address") -> DataFrame:
    c = F.col(column)
    parts = F.size(F.split(c, ",")).cast("double")
    return df.where(c.isNotNull() & (F.trim(c) != "")).agg(F.count("*").alias("total"), F.round(F.avg(F.length(c)), 1).alias("avg_len"), F.round(F.avg(parts), 1).alias("avg_components"), F.count_if(c.rlike(whole_word(f"({LANDMARKS})"))).alias("landmark_cnt"))


def length_stats(df: DataFrame) -> DataFrame:
    size = lambda c: F.length(F.col(c))
    return df.agg(F.round(F.avg(size("business_name")), 1).alias("avg_name_len"), F.max(size("business_name")).alias("max_name_len"), F.round(F.avg(size("business_address")), 1).alias("avg_addr_len"), F.max(size("business_address")).alias("max_addr_len"))
