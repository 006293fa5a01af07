"""The queries of the profiling and record linkage operators on the driver's tables, each beside its SQL.

Records are the rows of `documents`: the name is the first line of the text, the address all other lines, the country its
language. Sources src0 to src4 are the first source, src5 to src11 the second, the others the third. Two records match
when their texts and languages are equal.

Cosines and similarities of pairs are made for names and addresses, and some of them take the product of two lengths. There,
and only there, a record's name is the first 60 characters of the text and its address the next 120.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyweave.functions import fuzzy, phonetic, text
from tallyweave.operators import blocking, candidates, eda, evaluate, features, ground_truth, profile, tfidf, training
from tallyweave.plans import linkage
from tallyweave.sources import delimited

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def query(sql: str | None = None):
    def add(function):
        _QUERIES[function.__name__] = function
        if sql is not None:
            _SQL[function.__name__] = sql
        return function

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Records and their SQL.


def _records(spark: SparkSession, sf_dir: str, name: Column, address: Column) -> DataFrame:
    number = F.substr(F.col("source"), F.lit(4)).cast("int")
    prefix = F.when(number < 5, "S1-").when(number < 12, "S2-").otherwise("S3-")
    return table(spark, sf_dir, "documents").select(F.concat(prefix, F.col("doc_id").cast("string")).alias("entity_id"), name.alias("business_name"), address.alias("business_address"), F.col("lang").alias("country"), "text")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts: the first line is the name, the others are the address."""
    name = F.substring_index("text", "\n", 1)
    return _records(spark, sf_dir, name, F.substr(F.col("text"), F.length(name) + 2))


def short_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and addresses as long as real ones, for what compares pairs."""
    return _records(spark, sf_dir, F.substring("text", 1, 60), F.substring("text", 61, 120))


def sides(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    first = F.startswith("entity_id", F.lit("S1-"))
    return rows.where(first), rows.where(~first)


def truth(rows: DataFrame) -> DataFrame:
    """s1_id, cand_id of equal texts; equality is of a digest, so texts aren't dealt out."""
    digest = F.sha2(F.col("text"), 256)
    s1, pool = sides(rows.select("entity_id", "country", digest.alias("digest")))
    return s1.toDF("s1_id", "country", "digest").join(pool.toDF("cand_id", "country", "digest"), ["country", "digest"]).select("s1_id", "cand_id")


def gt(rows: DataFrame) -> DataFrame:
    return ground_truth.as_lists(truth(rows).toDF("source1_entity_id", "target_entity_id"), sides(rows)[0])


def plain_address(column: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(column), "[^a-z0-9]+", " "))


def plain_records(spark: SparkSession, sf_dir: str, short: bool = False) -> DataFrame:
    """Records normalized by expressions alone."""
    rows = (short_records if short else records)(spark, sf_dir)
    return rows.select("entity_id", text.plain_name(F.col("business_name")).alias("name_norm"), plain_address(F.col("business_address")).alias("addr_norm"), F.col("country").alias("country_norm"), "text", "country")


def _rec_sql(name: str, address: str) -> str:
    return f"""rec AS (SELECT (CASE WHEN CAST(substr(source, 4) AS INT) < 5 THEN 'S1-' WHEN CAST(substr(source, 4) AS INT) < 12 THEN 'S2-' ELSE 'S3-' END) || CAST(doc_id AS VARCHAR) AS entity_id,
 {name} AS business_name, {address} AS business_address, lang AS country, text FROM documents),
 truth AS (SELECT a.entity_id AS s1_id, b.entity_id AS cand_id FROM rec a JOIN rec b ON a.text = b.text AND a.country = b.country WHERE a.entity_id LIKE 'S1-%' AND b.entity_id NOT LIKE 'S1-%'),
 gt AS (SELECT r.entity_id AS source1_entity_id, l.ids AS matched_entity_ids FROM rec r LEFT JOIN (SELECT s1_id, string_agg(cand_id, ',' ORDER BY cand_id) AS ids FROM truth GROUP BY s1_id) l ON l.s1_id = r.entity_id WHERE r.entity_id LIKE 'S1-%')"""


_REC = _rec_sql("string_split(text, chr(10))[1]", "substr(text, length(string_split(text, chr(10))[1]) + 2)")
_REC_SHORT = _rec_sql("substr(text, 1, 60)", "substr(text, 61, 120)")


def _plain_sql(column: str) -> str:
    out = f"trim(regexp_replace(lower({column}), '[^a-z0-9]+', ' ', 'g'))"
    for pattern, long in text.NAME_RULES:
        quoted = pattern.replace("'", "''")
        out = f"regexp_replace({out}, '{quoted}', '{long}', 'g')"
    return f"trim(regexp_replace({out}, ' +', ' ', 'g'))"


def _norm_sql(rec: str) -> str:
    return rec + f""",
 norm0 AS (SELECT entity_id, {_plain_sql("business_name")} AS name_norm, trim(regexp_replace(lower(business_address), '[^a-z0-9]+', ' ', 'g')) AS addr_norm, country, text FROM rec),
 norm AS (SELECT *, list_filter(string_split(name_norm, ' '), lambda t: t <> '') AS toks, regexp_extract(addr_norm, '[0-9]+') AS house,
  coalesce(list_reduce(list_prepend('', regexp_extract_all(addr_norm, '[0-9]{{4,}}')), lambda b, x: CASE WHEN length(x) > length(b) THEN x ELSE b END), '') AS pin FROM norm0)"""


_NORM, _NORM_SHORT = _norm_sql(_REC), _norm_sql(_REC_SHORT)

# Profiles.


def _distinct_sql(name: str, columns: list[str]) -> str:
    each = " UNION ALL ".join(f"SELECT '{c}' AS column_name, COUNT(*) AS n_rows, COUNT(*) - COUNT({c}) AS missing_count, COUNT(DISTINCT {c}) AS distinct_count FROM {name}" for c in columns)
    pct = lambda c: f"coalesce(round({c} * 100.0 / nullif(n_rows, 0), 4), 0.0)::DOUBLE"
    return f"SELECT column_name, n_rows, missing_count, {pct('missing_count')} AS missing_pct, distinct_count, {pct('distinct_count')} AS cardinality_pct FROM ({each})"


@query(_distinct_sql("orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]))
def profile_missing_distinct_orders(spark, sf_dir):
    return profile.missing_distinct(table(spark, sf_dir, "orders"))


@query(_distinct_sql("documents", ["doc_id", "text", "lang", "source", "n_chars"]))
def profile_missing_distinct_documents(spark, sf_dir):
    return profile.missing_distinct(table(spark, sf_dir, "documents"))


@query()
def profile_approx_distinct(spark, sf_dir):
    return profile.missing_distinct(table(spark, sf_dir, "lineitem"), approximate=True)


def _stats_sql(name: str, columns: list[str]) -> str:
    r = lambda e, n: f"round(CAST({e} AS DOUBLE), 4) AS {n}"
    return " UNION ALL ".join(f"SELECT '{c}' AS column_name, {r(f'MIN({c})', 'min')}, {r(f'MAX({c})', 'max')}, {r(f'AVG({c})', 'mean')}, {r(f'STDDEV({c})', 'std')}, {r(f'MEDIAN({c})', 'median')}, {r(f'QUANTILE_CONT({c}, 0.25)', 'p25')}, {r(f'QUANTILE_CONT({c}, 0.75)', 'p75')} FROM {name}" for c in columns)


@query(_stats_sql("lineitem", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]))
def profile_numeric_lineitem(spark, sf_dir):
    return profile.numeric_stats(table(spark, sf_dir, "lineitem"))


@query(_stats_sql("orders", ["o_orderkey", "o_custkey", "o_totalprice"]))
def profile_numeric_orders(spark, sf_dir):
    return profile.numeric_stats(table(spark, sf_dir, "orders"))


def _top_sql(name: str, columns: list[str], k: int = 5) -> str:
    each = " UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, COUNT(*) AS n, (SELECT COUNT(*) FROM {name}) AS total FROM {name} WHERE {c} IS NOT NULL GROUP BY 2" for c in columns)
    return f"SELECT column_name, CAST(rank AS INT) AS rank, value, n, round(n * 100.0 / total, 2)::DOUBLE AS pct FROM (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value) AS rank FROM ({each})) WHERE rank <= {k}"


@query(_top_sql("documents", ["text", "lang", "source"]))
def profile_top5_documents(spark, sf_dir):
    return profile.top_values(table(spark, sf_dir, "documents"), ["text", "lang", "source"])


@query(_top_sql("part", ["p_name", "p_brand", "p_type"]))
def profile_top5_part(spark, sf_dir):
    return profile.top_values(table(spark, sf_dir, "part"), ["p_name", "p_brand", "p_type"])


@query(_top_sql("events", ["event_type"]))
def profile_top5_events(spark, sf_dir):
    return profile.top_values(table(spark, sf_dir, "events"), ["event_type"])


@query("SELECT * FROM orders ORDER BY o_orderkey LIMIT 10")
def profile_preview(spark, sf_dir):
    return profile.preview(table(spark, sf_dir, "orders"), 10, ["o_orderkey"])


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, COUNT(*) AS n_rows FROM {t}" for t in TABLES))
def file_row_counts(spark, sf_dir):
    return eda.row_counts({t: table(spark, sf_dir, t) for t in TABLES})


# Exploration.


@query("SELECT coalesce(lang, 'MISSING') AS country, COUNT(*) AS n, round(COUNT(*) * 100.0 / (SELECT COUNT(*) FROM documents), 2)::DOUBLE AS pct FROM documents GROUP BY lang")
def country_distribution(spark, sf_dir):
    return eda.distribution(records(spark, sf_dir))


@query(f"WITH {_REC} SELECT COUNT(*) AS n_rows, COUNT(*) - COUNT(entity_id) AS missing_id, COUNT(*) - COUNT(business_name) AS missing_name, COUNT(*) - COUNT(business_address) AS missing_addr, COUNT(*) - COUNT(country) AS missing_country FROM rec")
def missing_fields(spark, sf_dir):
    return eda.missing_fields(records(spark, sf_dir))


@query(f"WITH {_REC} SELECT COUNT(*) AS total, count_if(business_name IS NULL)::BIGINT AS name_null, count_if(trim(business_name) = '')::BIGINT AS name_empty, count_if(business_address IS NULL)::BIGINT AS addr_null, count_if(trim(business_address) = '')::BIGINT AS addr_empty FROM rec")
def null_vs_empty(spark, sf_dir):
    return eda.null_vs_empty(records(spark, sf_dir))


@query(f"WITH {_REC} SELECT COUNT(*) AS total, count_if(business_name = lower(business_name) AND business_name <> upper(business_name))::BIGINT AS lower_cnt, count_if(business_name = upper(business_name) AND business_name <> lower(business_name))::BIGINT AS upper_cnt, count_if(business_name <> lower(business_name) AND business_name <> upper(business_name))::BIGINT AS mixed_cnt FROM rec WHERE trim(business_name) <> ''")
def case_variation(spark, sf_dir):
    return eda.case_variation(records(spark, sf_dir))


_DEVA = "regexp_matches(business_name, '[\\x{0900}-\\x{097F}]')"
_LATIN = "regexp_matches(business_name, '[a-zA-Z]')"


@query(f"WITH {_REC} SELECT COUNT(*) AS total, count_if({_DEVA} AND NOT {_LATIN})::BIGINT AS pure_devanagari, count_if({_DEVA} AND {_LATIN})::BIGINT AS mixed_script, count_if(NOT {_DEVA} AND {_LATIN})::BIGINT AS pure_latin, count_if(NOT {_DEVA} AND NOT {_LATIN})::BIGINT AS other_script FROM rec WHERE business_name IS NOT NULL")
def script_classes(spark, sf_dir):
    return eda.script_classes(records(spark, sf_dir))


@query(f"WITH {_REC} SELECT COUNT(*) AS total, count_if({_DEVA})::BIGINT AS devanagari_cnt FROM rec WHERE country = 'en' AND business_name IS NOT NULL")
def devanagari_in_country(spark, sf_dir):
    return eda.devanagari_in_country(records(spark, sf_dir), "en")


@query(f"WITH {_REC} SELECT entity_id, business_name, business_address FROM rec WHERE country = 'fr' ORDER BY entity_id LIMIT 5")
def country_samples(spark, sf_dir):
    return eda.country_rows(records(spark, sf_dir), "fr", 5).select("entity_id", "business_name", "business_address")


@query(f"WITH {_REC} SELECT COUNT(*) AS total, count_if(contains(business_name, '.'))::BIGINT AS has_period, count_if(contains(business_name, ''''))::BIGINT AS has_apostrophe, count_if(contains(business_name, '-'))::BIGINT AS has_hyphen, count_if(contains(business_name, '&'))::BIGINT AS has_ampersand, count_if(contains(business_name, '/') OR contains(business_name, '\\'))::BIGINT AS has_slash, count_if(contains(business_name, ','))::BIGINT AS has_comma FROM rec WHERE business_name IS NOT NULL")
def punctuation_freq(spark, sf_dir):
    return eda.punctuation(records(spark, sf_dir))


_WORDS = ("The", "And", "Of", "Ein", "Les", "Que", *eda.ABBREVIATIONS)


@query(f"WITH {_REC} " + " UNION ALL ".join(f"SELECT '{w}' AS abbreviation, count_if(regexp_matches(business_name, '(?i)\\b{w}\\b'))::BIGINT AS n, round(count_if(regexp_matches(business_name, '(?i)\\b{w}\\b')) * 100.0 / COUNT(*), 2)::DOUBLE AS pct FROM rec" for w in _WORDS))
def abbreviation_freq(spark, sf_dir):
    return eda.abbreviations(records(spark, sf_dir), words=_WORDS)


@query(f"WITH {_REC} SELECT COUNT(*) AS total, round(avg(length(business_address)), 1) AS avg_len, round(avg(len(string_split(business_address, ','))), 1) AS avg_components, count_if(regexp_matches(business_address, '(?i)\\b({eda.LANDMARKS})\\b'))::BIGINT AS landmark_cnt FROM rec WHERE trim(business_address) <> ''")
def address_patterns(spark, sf_dir):
    return eda.address_patterns(records(spark, sf_dir))


@query(f"WITH {_REC} SELECT round(avg(length(business_name)), 1) AS avg_name_len, max(length(business_name))::INT AS max_name_len, round(avg(length(business_address)), 1) AS avg_addr_len, max(length(business_address))::INT AS max_addr_len FROM rec")
def length_stats(spark, sf_dir):
    return eda.length_stats(records(spark, sf_dir))


# True matches.


@query(f"WITH {_REC}, m AS (SELECT CASE WHEN matched_entity_ids IS NULL OR trim(matched_entity_ids) = '' THEN 0 ELSE length(matched_entity_ids) - length(replace(matched_entity_ids, ',', '')) + 1 END AS num_matches FROM gt) SELECT CAST(num_matches AS INT) AS num_matches, COUNT(*) AS n, round(COUNT(*) * 100.0 / (SELECT COUNT(*) FROM m), 2)::DOUBLE AS pct FROM m GROUP BY num_matches")
def gt_num_matches_hist(spark, sf_dir):
    return ground_truth.match_histogram(gt(records(spark, sf_dir)))


@query(f"WITH {_REC} SELECT source1_entity_id, unnest(string_split(matched_entity_ids, ',')) AS target_entity_id FROM gt WHERE matched_entity_ids IS NOT NULL AND trim(matched_entity_ids) <> ''")
def gt_pairs_explode(spark, sf_dir):
    return ground_truth.pairs(gt(records(spark, sf_dir)))


@query(f"WITH {_REC} SELECT COUNT(*) AS pair_count, count_if(cand_id LIKE 'S2-%')::BIGINT AS s2_pairs, count_if(cand_id LIKE 'S3-%')::BIGINT AS s3_pairs FROM truth")
def gt_pairs_by_source(spark, sf_dir):
    return ground_truth.pairs_by_source(ground_truth.pairs(gt(records(spark, sf_dir))))


@query(f"WITH {_REC}, f AS (SELECT s1_id, bool_or(cand_id LIKE 'S2-%') AS has_s2, bool_or(cand_id LIKE 'S3-%') AS has_s3 FROM truth GROUP BY s1_id) SELECT has_s2, has_s3, COUNT(*) AS n FROM f GROUP BY ALL")
def gt_source_combo(spark, sf_dir):
    return ground_truth.source_combinations(ground_truth.pairs(gt(records(spark, sf_dir))))


@query(f"WITH {_REC} SELECT t.s1_id AS source1_entity_id, t.cand_id AS target_entity_id, a.business_name AS s1_name, a.business_address AS s1_addr, a.country, b.business_name AS target_name, b.business_address AS target_addr FROM truth t JOIN rec a ON a.entity_id = t.s1_id LEFT JOIN rec b ON b.entity_id = t.cand_id")
def gt_pair_details(spark, sf_dir):
    rows = records(spark, sf_dir)
    return ground_truth.pair_details(ground_truth.pairs(gt(rows)), *sides(rows))


@query(f"WITH {_REC} SELECT COUNT(*) AS total_pairs, count_if(regexp_matches(a.business_name, '[\\x{{0900}}-\\x{{097F}}]') <> regexp_matches(b.business_name, '[\\x{{0900}}-\\x{{097F}}]'))::BIGINT AS cross_script_pairs FROM truth t JOIN rec a ON a.entity_id = t.s1_id LEFT JOIN rec b ON b.entity_id = t.cand_id")
def cross_script_pairs(spark, sf_dir):
    rows = records(spark, sf_dir)
    return ground_truth.cross_script(ground_truth.pair_details(ground_truth.pairs(gt(rows)), *sides(rows)))


@query(f"WITH {_REC} SELECT entity_id, entity_id IN (SELECT cand_id FROM truth) AS is_wanted FROM rec WHERE entity_id NOT LIKE 'S1-%'")
def filter_wanted_semi_anti(spark, sf_dir):
    rows = records(spark, sf_dir)
    wanted = truth(rows).select(F.col("cand_id").alias("entity_id"))
    return training.select_pool(sides(rows)[1].select("entity_id"), wanted, rate=1.0).select("entity_id", "is_wanted")


# Normalization.


@query(f"WITH {_NORM} SELECT entity_id, name_norm, addr_norm FROM norm")
def norm_name_ascii(spark, sf_dir):
    return plain_records(spark, sf_dir).select("entity_id", "name_norm", "addr_norm")


_STOPS = ", ".join(f"'{w}'" for w in text.STOP_WORDS)


@query(f"WITH {_NORM}, c AS (SELECT entity_id, name_norm, array_to_string(list_filter(toks, lambda t: NOT list_contains([{_STOPS}], t) AND length(t) > 1), ' ') AS core FROM norm) SELECT entity_id, CASE WHEN core = '' THEN name_norm ELSE core END AS core_name FROM c")
def core_names(spark, sf_dir):
    return plain_records(spark, sf_dir).select("entity_id", text.core_name(F.col("name_norm")).alias("core_name"))


@query(f"WITH {_NORM} SELECT entity_id, house, pin FROM norm")
def house_pin_extract(spark, sf_dir):
    return plain_records(spark, sf_dir).select("entity_id", text.house_number(F.col("addr_norm")).alias("house"), text.longest_digits(F.col("addr_norm")).alias("pin"))


@query()
def normalized_records(spark, sf_dir):
    """The three styles of normalization, which need Unicode decomposition."""
    rows = records(spark, sf_dir)
    return rows.select("entity_id", *(f(c, s).alias(f"{n}_{s}") for s in text.STYLES for n, f, c in (("name", text.normalize_name, "business_name"), ("addr", text.normalize_address, "business_address"))))


@query()
def phonetic_codes(spark, sf_dir):
    words = text.tokens(F.col("name_norm"))
    return plain_records(spark, sf_dir).select("entity_id", phonetic.sounds(words).alias("sounds"), phonetic.metaphone_of(F.regexp_replace("name_norm", " ", "")).alias("whole"))


# Blocking.


def _keyed_sql(names: tuple[str, ...], most: int, total: int | None, cap: int | None = None, norm: str = _NORM) -> str:
    own = {"exact-name": "name_norm", "sorted-tokens": "array_to_string(list_sort(toks), ' ')", "addr-pin": "CASE WHEN house <> '' AND pin <> '' THEN house || '|' || pin ELSE '' END"}
    keys = " UNION ALL ".join(f"SELECT entity_id, {k} AS key_id, {cap or blocking.CAPS[n]} AS cap, country || '|' || {own[n]} AS key FROM norm WHERE name_norm <> '' AND {own[n]} <> ''" for k, n in enumerate(names))
    limit = f" WHERE rank <= {total}" if total else ""
    return f"""{norm}, keys AS ({keys}),
 light AS (SELECT key_id, key FROM keys WHERE entity_id NOT LIKE 'S1-%' GROUP BY ALL HAVING COUNT(*) <= {most}),
 firsts AS (SELECT * FROM (SELECT k.*, row_number() OVER (PARTITION BY key_id, key ORDER BY entity_id) AS nth FROM keys k JOIN light USING (key_id, key) WHERE entity_id NOT LIKE 'S1-%') WHERE nth <= cap),
 met AS (SELECT a.entity_id AS s1_id, b.entity_id AS cand_id, b.key_id, b.nth FROM keys a JOIN firsts b USING (key_id, key) WHERE a.entity_id LIKE 'S1-%'),
 once AS (SELECT s1_id, cand_id, min(key_id * 1000 + nth) AS best FROM met GROUP BY ALL),
 cands AS (SELECT s1_id, cand_id, key_id, rank FROM (SELECT s1_id, cand_id, CAST(best // 1000 AS INT) AS key_id, CAST(row_number() OVER (PARTITION BY s1_id ORDER BY best, cand_id) AS INT) AS rank FROM once){limit})"""


@query(f"WITH {_keyed_sql(('exact-name', 'sorted-tokens'), 10**12, None, 10)} SELECT * FROM cands")
def block_exact_keys(spark, sf_dir):
    return blocking.exact(*sides(plain_records(spark, sf_dir)))


@query(f"WITH {_keyed_sql(blocking.PLAIN_KEYS, 1000, 60)} SELECT * FROM cands")
def block_multikey(spark, sf_dir):
    return blocking.multikey(*sides(plain_records(spark, sf_dir)), blocking.PLAIN_KEYS)


@query(f"WITH {_keyed_sql(blocking.PLAIN_KEYS, 2, 60)} SELECT * FROM cands")
def block_heavy_key_drop(spark, sf_dir):
    return blocking.multikey(*sides(plain_records(spark, sf_dir)), blocking.PLAIN_KEYS, most=2)


@query()
def block_nine_keys(spark, sf_dir):
    return blocking.multikey(*sides(plain_records(spark, sf_dir)))


@query()
def block_eleven_keys(spark, sf_dir):
    rows = plain_records(spark, sf_dir).withColumn("core_name", text.core_name(F.col("name_norm")))
    return blocking.multikey(*sides(rows), blocking.ELEVEN_KEYS, postal=r"\b\d{5,6}\b")


@query(f"WITH {_NORM}, n AS (SELECT COUNT(*) AS n FROM norm), d AS (SELECT token, COUNT(*) AS df FROM (SELECT DISTINCT entity_id, unnest(toks) AS token FROM norm) GROUP BY token) SELECT token, df, round(ln((n + 1.0) / (df + 1.0)) + 1, 6) AS idf FROM d, n")
def idf_tokens(spark, sf_dir):
    return tfidf.token_idf(plain_records(spark, sf_dir)).withColumn("idf", F.round("idf", 6))


def _names(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    return sides(plain_records(spark, sf_dir, short=True).select("entity_id", "country", F.col("name_norm").alias("text")))


_TFIDF = f"""{_NORM_SHORT}, g AS (SELECT entity_id, country, gram, COUNT(*) AS tf FROM (SELECT entity_id, country, unnest(list_transform(range(1, length(name_norm) - 1), lambda i: substr(name_norm, i, 3))) AS gram FROM norm WHERE length(name_norm) >= 3) GROUP BY ALL),
 n AS (SELECT country, COUNT(*) AS n FROM norm WHERE entity_id NOT LIKE 'S1-%' GROUP BY country),
 voc AS (SELECT g.country, gram, ln((1 + n) / (1 + COUNT(*)::DOUBLE)) + 1 AS idf FROM g JOIN n USING (country) WHERE entity_id NOT LIKE 'S1-%' GROUP BY g.country, gram, n HAVING COUNT(*) >= 2 AND COUNT(*) <= 0.05 * n),
 raw AS (SELECT entity_id, g.country, g.gram, (1 + ln(tf)) * idf AS w FROM g JOIN voc ON voc.country = g.country AND voc.gram = g.gram),
 v AS (SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY entity_id)) AS u FROM raw),
 scores AS (SELECT a.entity_id AS s1_id, b.entity_id AS cand_id, round(sum(a.u * b.u), 6) AS score FROM v a JOIN v b USING (country, gram) WHERE a.entity_id LIKE 'S1-%' AND b.entity_id NOT LIKE 'S1-%' GROUP BY ALL),
 near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY score DESC, cand_id) AS rank FROM scores WHERE score > 0.15) WHERE rank <= 10)"""


def _near(spark, sf_dir):
    return tfidf.similar(*_names(spark, sf_dir), 10, 0.15, gram_of=lambda name: tfidf.grams(name, 3, 3), max_df=0.05, max_features=None, fit_sample=None)


@query(f"WITH {_TFIDF} SELECT s1_id, CAST(rank AS INT) AS rank, round(score + 1e-9, 4) AS score FROM near")
def tfidf_topk(spark, sf_dir):
    """Ranks 1 to 10 with their scores; sums of doubles in another order may swap two ids whose scores are all but equal."""
    return _near(spark, sf_dir).select("s1_id", "rank", F.round(F.col("score") + 1e-9, 4).alias("score"))  # halves of the sixth place round up on either side


@query(f"WITH {_TFIDF} SELECT s1_id, cand_id, round(score, 4) AS score FROM near WHERE rank <= 1")
def tfidf_best(spark, sf_dir):
    return _near(spark, sf_dir).where("rank <= 1").select("s1_id", "cand_id", F.round("score", 4).alias("score"))


@query()
def tfidf_word_grams(spark, sf_dir):
    """The configuration of the linkage: word-bound grams of 2 to 4 characters, a bounded vocabulary."""
    return tfidf.similar(*_names(spark, sf_dir), max_df=0.05)


_KEYED = _keyed_sql(blocking.PLAIN_KEYS, 1000, 60)
_UNION = f"""{_KEYED}, other AS (SELECT s1_id, cand_id, rank FROM (SELECT a.entity_id AS s1_id, b.entity_id AS cand_id, CAST(row_number() OVER (PARTITION BY a.entity_id ORDER BY b.entity_id) AS INT) AS rank FROM norm a JOIN norm b ON a.country = b.country AND substr(a.name_norm, 1, 6) = substr(b.name_norm, 1, 6) WHERE a.entity_id LIKE 'S1-%' AND b.entity_id NOT LIKE 'S1-%') WHERE rank <= 5),
 both_sets AS (SELECT s1_id, cand_id, min(s * 100000 + rank) AS best FROM (SELECT s1_id, cand_id, 0 AS s, rank FROM other UNION ALL SELECT s1_id, cand_id, 1, rank FROM cands) GROUP BY ALL)"""


@query(f"WITH {_UNION} SELECT s1_id, cand_id, from_set, rank FROM (SELECT s1_id, cand_id, CAST(best // 100000 AS INT) AS from_set, CAST(row_number() OVER (PARTITION BY s1_id ORDER BY best, cand_id) AS INT) AS rank FROM both_sets) WHERE rank <= 4")
def candidate_union_cap(spark, sf_dir):
    s1, pool = sides(plain_records(spark, sf_dir))
    return candidates.union_capped(_prefix_pairs(s1, pool, 6), blocking.multikey(s1, pool, blocking.PLAIN_KEYS), 4)


@query()
def linkage_candidates(spark, sf_dir):
    """The candidates of the linkage with its own parameters, of whole documents: TF-IDF's first 50 and nine keys, at most 60 for a record."""
    return linkage.block(*sides(plain_records(spark, sf_dir)), linkage.SETTINGS["v4"])


# Comparison of pairs.


def _pairs(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    s1, pool = sides(plain_records(spark, sf_dir, short=True))
    return blocking.exact(s1, pool).select("s1_id", "cand_id").unionByName(_neighbours(s1, pool)).distinct(), s1, pool


def _prefix_pairs(s1: DataFrame, pool: DataFrame, characters: int, n: int = 5) -> DataFrame:
    """s1_id, cand_id, rank: pairs that share country and first characters, with the first n pool records by id.

    Those are the same for all records with a prefix, so the pool is cut before the join.
    """
    cut = lambda df, name: df.select(F.col("entity_id").alias(name), "country", F.substring("name_norm", 1, characters).alias("p"))
    order = Window.partitionBy("country", "p").orderBy("cand_id")
    first = cut(pool, "cand_id").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    return cut(s1, "s1_id").join(first, ["country", "p"]).select("s1_id", "cand_id", "rank")


def _neighbours(s1: DataFrame, pool: DataFrame) -> DataFrame:
    """Pairs that share country and the first four characters, so that not all pairs are equal names."""
    return _prefix_pairs(s1, pool, 4).drop("rank")


_PAIRS = f"""{_keyed_sql(("exact-name", "sorted-tokens"), 10**12, None, 10, _NORM_SHORT)},
 nb AS (SELECT s1_id, cand_id FROM (SELECT a.entity_id AS s1_id, b.entity_id AS cand_id, row_number() OVER (PARTITION BY a.entity_id ORDER BY b.entity_id) AS rank FROM norm a JOIN norm b ON a.country = b.country AND substr(a.name_norm, 1, 4) = substr(b.name_norm, 1, 4) WHERE a.entity_id LIKE 'S1-%' AND b.entity_id NOT LIKE 'S1-%') WHERE rank <= 5),
 ids AS (SELECT s1_id, cand_id FROM cands UNION SELECT s1_id, cand_id FROM nb),
 prs AS (SELECT i.s1_id, i.cand_id, a.name_norm AS n1, b.name_norm AS n2, a.addr_norm AS a1, b.addr_norm AS a2, list_distinct(a.toks) AS t1, list_distinct(b.toks) AS t2,
  list_distinct(list_filter(string_split(a.addr_norm, ' '), lambda t: t <> '')) AS at1, list_distinct(list_filter(string_split(b.addr_norm, ' '), lambda t: t <> '')) AS at2,
  a.house AS h1, b.house AS h2, a.pin AS p1, b.pin AS p2, a.country AS c1, b.country AS c2, coalesce(a.toks[1], '') AS f1, coalesce(b.toks[1], '') AS f2,
  list_distinct(regexp_extract_all(a.addr_norm, '\\b[0-9]+\\b')) AS d1, list_distinct(regexp_extract_all(b.addr_norm, '\\b[0-9]+\\b')) AS d2
  FROM ids i JOIN norm a ON a.entity_id = i.s1_id JOIN norm b ON b.entity_id = i.cand_id)"""


def _jaccard_sql(a: str, b: str, empty: str = "0.0") -> str:
    shared = f"len(list_intersect({a}, {b}))"
    return f"CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN {empty} ELSE {shared}::DOUBLE / (len({a}) + len({b}) - {shared}) END"


def _grams_sql(c: str) -> str:
    return f"(CASE WHEN {c} = '' THEN [] WHEN length({c}) < 3 THEN [{c}] ELSE list_distinct(list_transform(range(1, length({c}) - 1), lambda i: substr({c}, i, 3))) END)"


_FEATURE_SQL = {
    "name_jaccard": _jaccard_sql("t1", "t2"),
    "name_overlap_min": "CASE WHEN len(t1) > 0 AND len(t2) > 0 THEN len(list_intersect(t1, t2))::DOUBLE / least(len(t1), len(t2)) ELSE 0.0 END",
    "name_overlap_max": "CASE WHEN len(t1) > 0 AND len(t2) > 0 THEN len(list_intersect(t1, t2))::DOUBLE / greatest(len(t1), len(t2)) ELSE 0.0 END",
    "addr_jaccard": _jaccard_sql("at1", "at2"),
    "addr_overlap_min": "CASE WHEN len(at1) > 0 AND len(at2) > 0 THEN len(list_intersect(at1, at2))::DOUBLE / least(len(at1), len(at2)) ELSE 0.0 END",
    "name_len_diff": "abs(length(n1) - length(n2))::DOUBLE / greatest(length(n1), length(n2), 1)",
    "addr_len_diff": "abs(length(a1) - length(a2))::DOUBLE / greatest(length(a1), length(a2), 1)",
    "name1_empty": "(n1 = '')::INT::DOUBLE",
    "name2_empty": "(n2 = '')::INT::DOUBLE",
    "addr1_empty": "(a1 = '')::INT::DOUBLE",
    "addr2_empty": "(a2 = '')::INT::DOUBLE",
    "country_match": "(c1 = c2)::INT::DOUBLE",
    "first_word_match": "(f1 <> '' AND f2 <> '' AND f1 = f2)::INT::DOUBLE",
    "num_jaccard": _jaccard_sql("d1", "d2", "1.0"),
    "is_s3": "(cand_id LIKE 'S3%')::INT::DOUBLE",
    "name_lev": "CASE WHEN n1 <> '' AND n2 <> '' THEN 1 - levenshtein(n1, n2)::DOUBLE / greatest(length(n1), length(n2)) ELSE 0.0 END",
    "addr_lev": "CASE WHEN a1 <> '' AND a2 <> '' THEN 1 - levenshtein(a1, a2)::DOUBLE / greatest(length(a1), length(a2)) ELSE 0.0 END",
    "name_gram3": _jaccard_sql(_grams_sql("n1"), _grams_sql("n2")),
    "addr_gram3": _jaccard_sql(_grams_sql("a1"), _grams_sql("a2")),
    "house_match": "(h1 <> '' AND h2 <> '' AND h1 = h2)::INT::DOUBLE",
    "pin_match": "(p1 <> '' AND p2 <> '' AND p1 = p2)::INT::DOUBLE",
    "house_mismatch_penalty": "(h1 <> '' AND h2 <> '' AND h1 <> h2)::INT::DOUBLE",
    "pin_mismatch_penalty": "(p1 <> '' AND p2 <> '' AND p1 <> p2)::INT::DOUBLE",
}


@query(f"WITH {_PAIRS} SELECT s1_id, cand_id, " + ", ".join(f"round({e}, 6) AS {n}" for n, e in _FEATURE_SQL.items()) + " FROM prs")
def pair_features_native(spark, sf_dir):
    """All features of version v4 that need no Python."""
    out = features.native_features(*_pairs(spark, sf_dir))
    return out.select("s1_id", "cand_id", *(F.round(n, 6).alias(n) for n in _FEATURE_SQL))


@query(f"WITH {_PAIRS}, x AS (SELECT *, {_jaccard_sql('at1', 'at2')} AS j FROM prs) SELECT s1_id, cand_id, (j > 0.6 AND h1 <> '' AND h2 <> '' AND h1 <> h2)::INT::DOUBLE AS same_street_diff_house FROM x")
def same_street(spark, sf_dir):
    pairs, s1, pool = _pairs(spark, sf_dir)
    both = [df.withColumn("core_name", text.core_name(F.col("name_norm"))) for df in (s1, pool)]
    return features.native_features(pairs, *both, version="v3").select("s1_id", "cand_id", "same_street_diff_house")


@query(f"WITH {_PAIRS} SELECT s1_id, cand_id, round(CASE WHEN n1 <> '' AND n2 <> '' THEN jaro_winkler_similarity(n1, n2) ELSE 0.0 END, 6) AS name_jw FROM prs")
def jaro_winkler(spark, sf_dir):
    joined = features.paired(*_pairs(spark, sf_dir))
    return joined.select("s1_id", "cand_id", F.round(fuzzy.SCORES["jw"](F.col("name1"), F.col("name2")), 6).alias("name_jw"))


def _all_features(version: str):
    def made(spark, sf_dir):
        """All features of the candidates of the linkage, of whole documents."""
        s1, pool = sides(plain_records(spark, sf_dir))
        pairs = linkage.block(s1, pool, linkage.SETTINGS["v4"]).select("s1_id", "cand_id")
        if version == "v3":
            s1, pool = (df.withColumn("core_name", text.core_name(F.col("name_norm"))) for df in (s1, pool))
        return features.features(pairs, s1, pool, version, tfidf.token_idf(s1) if version == "v3" else None)

    made.__name__ = f"features_{version}"
    return query()(made)


for _version in features.FEATURES:
    _all_features(_version)


# Evaluation; a rule stands for the model, so that SQL can follow.

_SCORED = f"{_PAIRS}, scored AS (SELECT s1_id, cand_id, round(0.5 * ({_FEATURE_SQL['name_jaccard']}) + 0.5 * ({_FEATURE_SQL['addr_jaccard']}), 6) AS prob FROM prs)"


def _scored(spark, sf_dir) -> DataFrame:
    out = features.native_features(*_pairs(spark, sf_dir))
    return out.select("s1_id", "cand_id", F.round(0.5 * F.col("name_jaccard") + 0.5 * F.col("addr_jaccard"), 6).alias("prob"))


@query(f"WITH {_keyed_sql(blocking.PLAIN_KEYS, 1000, 60)} SELECT COUNT(c.s1_id) AS found, COUNT(*) AS total, round(COUNT(c.s1_id)::DOUBLE / greatest(COUNT(*), 1), 6) AS recall FROM truth t LEFT JOIN cands c ON c.s1_id = t.s1_id AND c.cand_id = t.cand_id")
def blocking_recall(spark, sf_dir):
    rows = plain_records(spark, sf_dir)
    return evaluate.blocking_recall(truth(rows), blocking.multikey(*sides(rows), blocking.PLAIN_KEYS)).withColumn("recall", F.round("recall", 6))


_F05 = """CASE WHEN np = 0 AND nt = 0 THEN 1.0 WHEN np = 0 OR nt = 0 OR hit = 0 THEN 0.0 ELSE 1.25 * (hit::DOUBLE / np) * (hit::DOUBLE / nt) / (0.25 * (hit::DOUBLE / np) + hit::DOUBLE / nt) END"""


def _f05_sql(pred: str, extra: str = "") -> str:
    return f"""SELECT r.entity_id AS s1_id{extra}, (SELECT COUNT(*) FROM {pred} p JOIN truth t USING (s1_id, cand_id) WHERE p.s1_id = r.entity_id) AS hit, (SELECT COUNT(*) FROM {pred} p WHERE p.s1_id = r.entity_id) AS np, (SELECT COUNT(*) FROM truth t WHERE t.s1_id = r.entity_id) AS nt FROM rec r WHERE r.entity_id LIKE 'S1-%'"""


@query(f"WITH {_SCORED}, pred AS (SELECT s1_id, cand_id FROM scored WHERE prob >= 0.5), per AS ({_f05_sql('pred')}) SELECT COUNT(*) AS n_records, round(avg({_F05}), 6) AS f05 FROM per")
def f05_macro(spark, sf_dir):
    rows = plain_records(spark, sf_dir)
    predicted = candidates.at_threshold(_scored(spark, sf_dir), 0.5)
    return evaluate.macro_f_half(sides(rows)[0], predicted, truth(rows)).withColumn("f05", F.round("f05", 6))


_GRID = (0.3, 0.5, 0.7, 0.9, 1.0)
_GRID_SQL = f"WITH {_SCORED}, grid AS (SELECT unnest({[float(g) for g in _GRID]}::DOUBLE[]) AS threshold), cnt AS (SELECT g.threshold, s.s1_id, COUNT(t.s1_id) AS hit, COUNT(*) AS np FROM grid g JOIN scored s ON s.prob >= g.threshold LEFT JOIN truth t ON t.s1_id = s.s1_id AND t.cand_id = s.cand_id GROUP BY ALL), nt AS (SELECT s1_id, COUNT(*) AS nt FROM truth GROUP BY s1_id), per AS (SELECT g.threshold, r.entity_id, coalesce(c.hit, 0) AS hit, coalesce(c.np, 0) AS np, coalesce(n.nt, 0) AS nt FROM grid g JOIN rec r ON r.entity_id LIKE 'S1-%' LEFT JOIN cnt c ON c.threshold = g.threshold AND c.s1_id = r.entity_id LEFT JOIN nt n ON n.s1_id = r.entity_id)"


@query(f"{_GRID_SQL} SELECT threshold, round(avg({_F05}), 6) AS f05 FROM per GROUP BY threshold")
def threshold_grid(spark, sf_dir):
    rows = plain_records(spark, sf_dir)
    return evaluate.threshold_scores(sides(rows)[0], _scored(spark, sf_dir), truth(rows), _GRID).withColumn("f05", F.round("f05", 6))


@query(f"{_GRID_SQL} SELECT threshold, round(avg({_F05}), 6) AS f05 FROM per GROUP BY threshold ORDER BY round(avg({_F05}), 12) DESC, threshold LIMIT 1")
def best_threshold(spark, sf_dir):
    rows = plain_records(spark, sf_dir)
    return evaluate.best_threshold(evaluate.threshold_scores(sides(rows)[0], _scored(spark, sf_dir), truth(rows), _GRID)).withColumn("f05", F.round("f05", 6))


@query(f"WITH {_SCORED}, k AS (SELECT s1_id, cand_id, prob, row_number() OVER w AS rank, max(prob) OVER (PARTITION BY s1_id, cand_id LIKE 'S2%') AS top FROM scored WHERE prob >= 0.2 WINDOW w AS (PARTITION BY s1_id, cand_id LIKE 'S2%' ORDER BY prob DESC, cand_id)) SELECT s1_id, cand_id, prob, CAST(rank AS INT) AS rank FROM k WHERE rank = 1 OR (rank = 2 AND prob >= 0.9 AND top - prob < 0.03)")
def rank_filter_top1(spark, sf_dir):
    return candidates.rank_filter(_scored(spark, sf_dir), 0.2)


@query(f"WITH {_KEYED}, pos AS (SELECT s1_id, cand_id FROM truth), neg AS (SELECT s1_id, cand_id, row_number() OVER (PARTITION BY s1_id ORDER BY rank, cand_id) AS nth FROM cands c WHERE NOT EXISTS (SELECT 1 FROM truth t WHERE t.s1_id = c.s1_id AND t.cand_id = c.cand_id)), k AS (SELECT s1_id, COUNT(*) AS n FROM truth GROUP BY s1_id) SELECT s1_id, cand_id, 1 AS label FROM pos UNION ALL SELECT neg.s1_id, cand_id, 0 FROM neg LEFT JOIN k ON k.s1_id = neg.s1_id WHERE nth <= greatest(3 * coalesce(n, 0), 2)")
def train_pairs_sampler(spark, sf_dir):
    rows = plain_records(spark, sf_dir)
    s1, pool = sides(rows)
    return training.training_pairs(truth(rows), blocking.multikey(s1, pool, blocking.PLAIN_KEYS), pool, s1)


@query()
def gbt_score(spark, sf_dir):
    """Boosted trees on the expression features, scored on all pairs; 20 trees stand for the hundreds of the linkage."""
    rows = plain_records(spark, sf_dir)
    pairs, s1, pool = _pairs(spark, sf_dir)
    columns = list(_FEATURE_SQL)
    found = features.native_features(pairs, s1, pool)
    labelled = found.join(truth(rows).withColumn("label", F.lit(1)), ["s1_id", "cand_id"], "left").fillna(0, ["label"])
    return training.score(found, training.train(labelled, columns, trees=20, depth=6), columns)


@query(f"WITH {_SCORED} SELECT r.entity_id AS source1_entity_id, coalesce((SELECT string_agg(cand_id, ',' ORDER BY prob DESC, cand_id) FROM scored s WHERE s.s1_id = r.entity_id AND prob >= 0.5), '') AS matched_entity_ids FROM rec r WHERE r.entity_id LIKE 'S1-%'")
def matches_tsv_rows(spark, sf_dir):
    matched = candidates.at_threshold(_scored(spark, sf_dir), 0.5).withColumn("rank", -F.col("prob"))
    return delimited.matches_table(sides(records(spark, sf_dir))[0], matched)


@query(f"WITH {_KEYED} SELECT r.entity_id AS source1_entity_id, coalesce((SELECT string_agg(cand_id, ',' ORDER BY rank, cand_id) FROM cands c WHERE c.s1_id = r.entity_id), '') AS candidate_entity_ids FROM rec r WHERE r.entity_id LIKE 'S1-%'")
def candidates_tsv_rows(spark, sf_dir):
    s1, pool = sides(plain_records(spark, sf_dir))
    return delimited.candidates_table(s1, blocking.multikey(s1, pool, blocking.PLAIN_KEYS))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile_missing_distinct_documents(spark, sf_dir)
