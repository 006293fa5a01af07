"""Similarity features of candidate pairs.

A pair frame carries ids until here; names and addresses are joined last. All features that expressions can state are
expressions, and all that they can't makes one trip to Python. Names and addresses may be whole documents: for all features
together the second side's texts lie in files and are read where a pair is compared, and what texts are cut into is made there
after the trip to Python, so that neither is sent or held beside the rows that wait for their scores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions import fuzzy, phonetic, text
from tallyweave.sources import texts

_FUZZY = ("ratio", "partial_ratio", "token_sort", "token_set", "WRatio")
_BASE = (
    *(f"name_{f}" for f in _FUZZY), *(f"addr_{f}" for f in _FUZZY), "name_jaccard", "name_overlap_min", "name_overlap_max",
    "addr_jaccard", "addr_overlap_min", "name_len_diff", "addr_len_diff", "name1_empty", "name2_empty", "addr1_empty",
    "addr2_empty", "country_match", "first_word_match", "first_word_sim", "num_jaccard", "is_s3",
)
_EDIT = ("name_lev", "addr_lev", "name_gram3", "addr_gram3", "name_phon_exact", "name_phon_jaccard", "house_match", "pin_match")
_JW = ("name_jw", "addr_jw")
_PENALTY = ("house_mismatch_penalty", "pin_mismatch_penalty")
_CORE = ("name_lcs_ratio", "addr_lcs_ratio", "core_name_ratio", "core_name_jaccard", "weighted_name_jaccard", "weighted_addr_jaccard")

#: Names of the features in order, by version.
FEATURES = {"baseline": _BASE, "v2": _BASE + _EDIT, "v3": _BASE + _EDIT + _JW + _CORE + _PENALTY + ("same_street_diff_house",), "v4": _BASE + _EDIT + _JW + _PENALTY}
#: Those that expressions state without Python.
NATIVE = (
    "name_jaccard", "name_overlap_min", "name_overlap_max", "addr_jaccard", "addr_overlap_min", "name_len_diff", "addr_len_diff",
    "name1_empty", "name2_empty", "addr1_empty", "addr2_empty", "country_match", "first_word_match", "num_jaccard", "is_s3",
    "name_lev", "addr_lev", "name_gram3", "addr_gram3", "house_match", "pin_match", "core_name_jaccard", *_PENALTY, "same_street_diff_house",
)


def _flag(condition: Column) -> Column:
    return F.when(condition, 1.0).otherwise(0.0)


def _over(part: Column, whole: Column, empty: float = 0.0) -> Column:
    return F.when(whole > 0, part.cast("double") / whole).otherwise(F.lit(empty))


def jaccard(a: Column, b: Column, both_empty: float = 0.0) -> Column:
    """Of two arrays of distinct elements; `both_empty` where neither has any, 0 where one has none."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), both_empty).otherwise(_over(shared, F.size(a) + F.size(b) - shared))


def overlap(a: Column, b: Column, least: bool) -> Column:
    pick = F.least if least else F.greatest
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)).cast("double") / pick(F.size(a), F.size(b))).otherwise(0.0)


def length_difference(a: Column, b: Column) -> Column:
    return F.abs(F.length(a) - F.length(b)).cast("double") / F.greatest(F.length(a), F.length(b), F.lit(1))


def edit_similarity(a: Column, b: Column) -> Column:
    return F.when((a != "") & (b != ""), 1 - F.levenshtein(a, b).cast("double") / F.greatest(F.length(a), F.length(b))).otherwise(0.0)


def numbers(column: Column) -> Column:
    """Distinct whole words of digits."""
    return F.array_distinct(F.regexp_extract_all(column, F.lit(r"(?U)\b([0-9]+)\b"), F.lit(1)))


def plain_side(records: DataFrame, number: int, version: str = "v4") -> DataFrame:
    """The texts of a side of a pair, which are all that is sent for each pair."""
    of = lambda c: F.coalesce(F.col(c), F.lit("")) if c in records.columns else F.lit("")
    rows = records.select("entity_id", of("name_norm").alias("name"), of("addr_norm").alias("addr"), of("country_norm").alias("country"), *([of("core_name").alias("core")] if version == "v3" else []))
    return rows.select(*(F.col(c).alias(f"{c}{number}") for c in rows.columns))


def with_parts(rows: DataFrame, number: int, postal: str = r"\d{4,}") -> DataFrame:
    """What the features need besides the texts of a side."""
    name, address = F.col(f"name{number}"), F.col(f"addr{number}")
    made = {"tokens": F.array_distinct(text.tokens(name)), "addr_tokens": F.array_distinct(text.tokens(address)), "first": F.coalesce(F.get(text.tokens(name), F.lit(0)), F.lit("")), "nums": numbers(address), "house": text.house_number(address), "pin": text.longest_digits(address, postal), "gram": text.grams(name), "addr_gram": text.grams(address)}
    return rows.withColumns({f"{c}{number}": v for c, v in made.items()})


def side(records: DataFrame, number: int, version: str = "v4", postal: str = r"\d{4,}") -> DataFrame:
    """A side with all that the features need, worked out once for each record."""
    return with_parts(plain_side(records, number, version), number, postal)


def _native(version: str) -> dict[str, Column]:
    c = lambda n: (F.col(f"{n}1"), F.col(f"{n}2"))
    (n1, n2), (a1, a2), (f1, f2), (h1, h2), (p1, p2) = c("name"), c("addr"), c("first"), c("house"), c("pin")
    both = lambda x, y: (x != "") & (y != "")
    out = {
        "name_jaccard": jaccard(*c("tokens")),
        "name_overlap_min": overlap(*c("tokens"), True),
        "name_overlap_max": overlap(*c("tokens"), False),
        "addr_jaccard": jaccard(*c("addr_tokens")),
        "addr_overlap_min": overlap(*c("addr_tokens"), True),
        "name_len_diff": length_difference(n1, n2),
        "addr_len_diff": length_difference(a1, a2),
        "name1_empty": _flag(n1 == ""),
        "name2_empty": _flag(n2 == ""),
        "addr1_empty": _flag(a1 == ""),
        "addr2_empty": _flag(a2 == ""),
        "country_match": _flag(F.col("country1") == F.col("country2")),
        "first_word_match": _flag(both(f1, f2) & (f1 == f2)),
        "num_jaccard": jaccard(*c("nums"), both_empty=1.0),
        "is_s3": _flag(F.startswith(F.col("entity_id2"), F.lit("S3"))),
        "name_lev": edit_similarity(n1, n2),
        "addr_lev": edit_similarity(a1, a2),
        "name_gram3": jaccard(*c("gram")),
        "addr_gram3": jaccard(*c("addr_gram")),
        "house_match": _flag(both(h1, h2) & (h1 == h2)),
        "pin_match": _flag(both(p1, p2) & (p1 == p2)),
        "house_mismatch_penalty": _flag(both(h1, h2) & (h1 != h2)),
        "pin_mismatch_penalty": _flag(both(p1, p2) & (p1 != p2)),
        "same_street_diff_house": _flag((jaccard(*c("addr_tokens")) > 0.6) & both(h1, h2) & (h1 != h2)),
    }
    if version == "v3":
        words = lambda k: F.array_distinct(text.tokens(F.col(f"core{k}")))
        out["core_name_jaccard"] = jaccard(words(1), words(2))
    return out


def paired(pairs: DataFrame, s1: DataFrame, pool: DataFrame, version: str = "v4", postal: str = r"\d{4,}") -> DataFrame:
    """Both sides' columns beside each pair (s1_id, cand_id).

    The second side is sent with each pair, and so its texts alone; what they are cut into is made where the pair meets its
    first side.
    """
    one, two = side(s1, 1, version, postal), _sent(plain_side(pool, 2, version))
    joined = pairs.join(two, F.col("cand_id") == F.col("entity_id2")).join(one, F.col("s1_id") == F.col("entity_id1"))
    return with_parts(_received(joined), 2, postal)


def _met(pairs: DataFrame, s1: DataFrame, pool: DataFrame, version: str, postal: str, idf: DataFrame | None) -> DataFrame:
    """Both sides' texts beside each pair. The second side's are read from files, so that pairs are joined by their ids alone.

    Word weights come by record: the first side has those of its words, the second the sums of its own. So do the sounds of a
    first side.
    """
    one, two = plain_side(s1, 1, version), _sent(plain_side(pool, 2, version))
    places = texts.put(two, "entity_id2")
    if idf is not None:
        places = places.join(_totals(with_parts(two, 2, postal), idf), "entity_id2", "left")
        one = one.join(_weights(with_parts(one, 1, postal), 1, idf), "entity_id1", "left")
    if version != "baseline":
        one = one.withColumn("sound1", phonetic.sound_set(F.array_distinct(text.tokens(F.col("name1")))))
    placed = pairs.join(places, F.col("cand_id") == F.col("entity_id2")).drop("entity_id2")
    joined = placed.join(one, F.col("s1_id") == F.col("entity_id1")).drop("entity_id1")
    return _received(texts.get(joined, two.columns[1:]))


def _sent(two: DataFrame) -> DataFrame:
    """A core name that is the whole name is not sent beside it."""
    return two.withColumn("core2", F.when(F.col("core2") != F.col("name2"), F.col("core2"))) if "core2" in two.columns else two


def _received(joined: DataFrame) -> DataFrame:
    """What was left out of a row, as the id that it was joined by and an equal core name."""
    if "cand_id" in joined.columns:
        joined = joined.withColumn("entity_id2", F.col("cand_id"))
    return joined.withColumn("core2", F.coalesce("core2", "name2")) if "core2" in joined.columns else joined


def native_features(pairs: DataFrame, s1: DataFrame, pool: DataFrame, version: str = "v4", postal: str = r"\d{4,}") -> DataFrame:
    """The pair's columns and those of its features that need no Python."""
    made = _native(version)
    return paired(pairs, s1, pool, version, postal).select(*pairs.columns, *(made[n].alias(n) for n in FEATURES[version] if n in made))


def features(pairs: DataFrame, s1: DataFrame, pool: DataFrame, version: str = "v4", idf: DataFrame | None = None, postal: str = r"\d{4,}") -> DataFrame:
    """The pair's columns and all features of a version in order, as doubles.

    v3 takes word weights (token, idf) for the weighted similarities; without them those are plain.
    """
    joined = _met(pairs, s1, pool, version, postal, idf if version == "v3" else None)
    made = _native(version)
    wanted = tuple(f for f in (*_FUZZY, "jw", "lcs_ratio") if f"name_{f}" in FEATURES[version])
    scores, ratio = fuzzy.all_scores((*wanted, "edits") if version != "baseline" else wanted), fuzzy.SCORES["ratio"]
    first = lambda k: F.regexp_extract(f"name{k}", r"(\S+)", 1)
    found = {"name_scores": scores("name1", "name2"), "addr_scores": scores("addr1", "addr2"), "first_ratio": ratio(first(1), first(2))}
    if version != "baseline":
        found["sound2"] = phonetic.sound_set(F.array_distinct(text.tokens(F.col("name2"))))
    if version == "v3":
        found["core_ratio"] = ratio(F.col("core1"), F.col("core2"))
    joined = with_parts(with_parts(joined.withColumns(found), 1, postal), 2, postal)
    for of in ("name", "addr"):
        made |= {f"{of}_{f}": F.col(f"{of}_scores.{f}") for f in wanted}
        if version != "baseline":
            edits, longer = F.col(f"{of}_scores.edits"), F.greatest(F.length(f"{of}1"), F.length(f"{of}2"))
            made[f"{of}_lev"] = F.when(F.isnan(edits), made[f"{of}_lev"]).otherwise(1 - edits / longer)
    both = (F.col("first1") != "") & (F.col("first2") != "")
    made["first_word_sim"] = F.when(both, F.col("first_ratio")).otherwise(0.0)
    if version != "baseline":
        made["name_phon_jaccard"] = jaccard(F.col("sound1"), F.col("sound2"))
        made["name_phon_exact"] = _flag((F.size("sound1") > 0) & (F.col("sound1") == F.col("sound2")))
    if version == "v3":
        made["core_name_ratio"] = F.when((F.col("core1") != "") & (F.col("core2") != ""), F.col("core_ratio")).otherwise(0.0)
        made["weighted_name_jaccard"], made["weighted_addr_jaccard"] = made["name_jaccard"], made["addr_jaccard"]
        if idf is not None:
            made["weighted_name_jaccard"], made["weighted_addr_jaccard"] = _weighted("tokens", "name_total2"), _weighted("addr_tokens", "addr_total2")
    return joined.select(*pairs.columns, *(made[n].cast("double").alias(n) for n in FEATURES[version]))


def _weights(rows: DataFrame, number: int, idf: DataFrame) -> DataFrame:
    """weights: the weight of each word of a record's name and address, 1 for those without one."""
    key = f"entity_id{number}"
    words = rows.select(key, F.explode(F.array_union(f"tokens{number}", f"addr_tokens{number}")).alias("token")).distinct()
    weighed = words.join(idf.select("token", "idf"), "token", "left").select(key, F.struct("token", F.coalesce("idf", F.lit(1.0)).alias("idf")).alias("w"))
    return weighed.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list("w"))).alias(f"weights{number}"))


def _sum(words: Column, weights: Column) -> Column:
    return F.aggregate(words, F.lit(0.0), lambda total, t: total + F.element_at(weights, t))


def _totals(rows: DataFrame, idf: DataFrame) -> DataFrame:
    """name_total2 and addr_total2: the weights of all words of a record."""
    joined = rows.select("entity_id2", "tokens2", "addr_tokens2").join(_weights(rows, 2, idf), "entity_id2")
    return joined.select("entity_id2", _sum(F.col("tokens2"), F.col("weights2")).alias("name_total2"), _sum(F.col("addr_tokens2"), F.col("weights2")).alias("addr_total2"))


def _weighted(tokens: str, total: str) -> Column:
    """The weight of a pair's shared words over that of all its words."""
    one, two, weights = F.col(f"{tokens}1"), F.col(f"{tokens}2"), F.col("weights1")
    shared = _sum(F.array_intersect(one, two), weights)
    return F.when((F.size(one) > 0) & (F.size(two) > 0), shared / F.greatest(_sum(one, weights) + F.col(total) - shared, F.lit(1e-5))).otherwise(0.0)
