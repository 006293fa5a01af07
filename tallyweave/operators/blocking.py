"""Candidate pairs by exact keys.

All keys of a record are one array that is exploded, so both sides meet in a single join on (key number, key). Keys that
too many pool records share are dropped on both sides. A record takes the first `cap` pool records of a key in the order
of their ids, the same for all records with that key; so the pool is cut to `cap` rows a key before the join, and no key
gives more than that to any record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.functions import phonetic, text

#: The most pool records of a key, and the most candidates of a record.
MAX_KEY_FREQUENCY = 1000
CAP_TOTAL = 60
#: Keys in order of priority, with the most candidates that each gives.
CAPS = {
    "exact-name": 20, "sorted-tokens": 20, "phonetic-set": 20, "full-phonetic": 20, "brand-end": 15, "core-brand": 15,
    "addr-anchor": 10, "addr-pin": 10, "brand-pin": 10, "phon-prefix": 10, "cross-country": 10,
}
PLAIN_KEYS = ("exact-name", "sorted-tokens", "addr-pin")
NINE_KEYS = ("exact-name", "sorted-tokens", "phonetic-set", "full-phonetic", "brand-end", "addr-anchor", "addr-pin", "brand-pin", "phon-prefix")
ELEVEN_KEYS = tuple(CAPS)


def _joined(*parts: Column) -> Column:
    """Parts with bars between; null, and so no key, where any part but the first is null or empty."""
    missing = F.lit(False)
    for p in parts[1:]:
        missing = missing | p.isNull() | (p == "")
    return F.when(~missing, F.concat_ws("|", *parts))


def record_keys(records: DataFrame, names: tuple[str, ...] = NINE_KEYS, postal: str = r"\d{4,}", keep: tuple[str, ...] = ()) -> DataFrame:
    """entity_id, key_id (priority), cap, key of each key that a normalized record has.

    A key's own part must not be empty; the country before it doesn't count, so short names are treated alike in all
    countries. Without phonetic keys nothing leaves the JVM.
    """
    name = F.coalesce(F.col("name_norm"), F.lit(""))
    address = F.coalesce(F.col("addr_norm"), F.lit(""))
    rows = records.select("entity_id", *keep, F.coalesce("country_norm", F.lit("")).alias("c"), name.alias("name"), text.tokens(name).alias("tokens"), text.house_number(address).alias("house"), text.longest_digits(address, postal).alias("pin"), *([F.col("core_name")] if "core-brand" in names else []))
    if set(names) - set(PLAIN_KEYS):
        rows = rows.withColumn("sounds", phonetic.sounds(F.col("tokens"))).withColumn("whole", phonetic.metaphone_of(F.regexp_replace("name", r"\s+", "")))
        long = F.filter(F.arrays_zip("tokens", "sounds"), lambda z: F.length(z["tokens"]) > 1)
        rows = rows.withColumn("sound_set", F.array_join(F.array_sort(F.array_distinct(F.transform(long, lambda z: z["sounds"]))), "|"))
    c, first, last = F.col("c"), F.get("sounds", F.lit(0)), F.get("sounds", F.size("sounds") - 1)
    made = {
        "exact-name": lambda: _joined(c, F.col("name")),
        "sorted-tokens": lambda: _joined(c, F.array_join(F.array_sort("tokens"), " ")),
        "phonetic-set": lambda: _joined(c, F.col("sound_set")),
        "full-phonetic": lambda: _joined(c, F.col("whole")),
        "brand-end": lambda: _joined(c, first, last),
        "core-brand": lambda: _joined(c, F.substring("core_name", 1, 4), first),
        "addr-anchor": lambda: _joined(c, F.col("house"), first),
        "addr-pin": lambda: _joined(c, F.col("house"), F.col("pin")),
        "brand-pin": lambda: _joined(c, F.col("pin"), first),
        "phon-prefix": lambda: _joined(c, F.substring("whole", 1, 5), F.col("house")),
        "cross-country": lambda: _joined(F.substring("whole", 1, 6), F.substring("whole", 1, 6), F.col("house")),
    }
    keys = F.array(*(F.struct(F.lit(k).alias("key_id"), F.lit(CAPS[n]).alias("cap"), F.when(F.col("name") != "", made[n]()).alias("key")) for k, n in enumerate(names)))
    return rows.select("entity_id", *keep, F.explode(keys).alias("k")).select("entity_id", *keep, "k.*").where("key is not null")


def light_keys(pool_keys: DataFrame, most: int = MAX_KEY_FREQUENCY) -> DataFrame:
    """(key_id, key) that at most so many pool records have."""
    return pool_keys.groupBy("key_id", "key").agg(F.count("*").alias("n")).where(F.col("n") <= most).select("key_id", "key")


def join_keys(s1_keys: DataFrame, pool_keys: DataFrame, most: int = MAX_KEY_FREQUENCY) -> DataFrame:
    """s1_id, cand_id, key_id, rank: for each key of a record its first `cap` pool records by id."""
    light = pool_keys.join(light_keys(pool_keys, most), ["key_id", "key"], "left_semi")
    order = Window.partitionBy("key_id", "key").orderBy("entity_id")
    first = light.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= F.col("cap"))
    pool = first.select("key_id", "key", "rank", F.col("entity_id").alias("cand_id"))
    return s1_keys.select("key_id", "key", F.col("entity_id").alias("s1_id")).join(pool, ["key_id", "key"]).select("s1_id", "cand_id", "key_id", "rank")


def ranked(candidates: DataFrame, total: int | None = CAP_TOTAL) -> DataFrame:
    """s1_id, cand_id, key_id, rank: each pair once, under its first key, and the first `total` of each record.

    Pairs are dealt by their record, so that they meet and are ranked after one shuffle.
    """
    once = candidates.repartition("s1_id").groupBy("s1_id", "cand_id").agg(F.min(F.struct("key_id", "rank")).alias("best"))
    order = Window.partitionBy("s1_id").orderBy("best.key_id", "best.rank", "cand_id")
    out = once.withColumn("rank", F.row_number().over(order))
    out = out if total is None else out.where(F.col("rank") <= total)
    return out.select("s1_id", "cand_id", F.col("best.key_id").alias("key_id"), "rank")


def multikey(s1: DataFrame, pool: DataFrame, names: tuple[str, ...] = NINE_KEYS, total: int = CAP_TOTAL, most: int = MAX_KEY_FREQUENCY, postal: str = r"\d{4,}") -> DataFrame:
    """Candidates by all keys in order of priority, at most `total` for each record."""
    return ranked(join_keys(record_keys(s1, names, postal), record_keys(pool, names, postal), most), total)


def exact(s1: DataFrame, pool: DataFrame, cap: int = 10) -> DataFrame:
    """The quick way: equal names or equal sorted words, `cap` candidates for each of the two keys, no key dropped."""
    cut = lambda keys: keys.withColumn("cap", F.lit(cap))
    names = ("exact-name", "sorted-tokens")
    return ranked(join_keys(cut(record_keys(s1, names)), cut(record_keys(pool, names)), 1 << 62), None)
