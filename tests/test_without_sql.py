"""The queries that have no SQL, against plain Python over the same tables."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyweave.functions import fuzzy, phonetic, text
from tallyweave.operators import blocking, candidates, features, profile, tfidf
from tallyweave.plans import catalogue

SF = "/root/testdata/sf0.001"


def plain_norm(spark, short):
    """entity_id to (name, address, country) of the normalized records, by row-wise code."""
    rows = (catalogue.short_records if short else catalogue.records)(spark, SF).collect()
    spaced = lambda t: re.sub("[^a-z0-9]+", " ", t.lower()).strip(" ")
    out = {}
    for r in rows:
        name = spaced(r.business_name)
        for pattern, long in text.NAME_RULES:
            name = re.sub(pattern, long, name)
        out[r.entity_id] = (re.sub(" +", " ", name).strip(" "), spaced(r.business_address), r.country)
    return out


def core_of(name):
    return " ".join(t for t in name.split() if t not in text.STOP_WORDS and len(t) > 1) or name


def longest(found):
    return max(found, key=len, default="")


def keys_of(name, address, country, names, postal):
    """(key number, key) of a record by the definitions of the keys."""
    words = name.split()
    sounds = [phonetic.sound(w) for w in words]
    first, last = (sounds[0], sounds[-1]) if sounds else ("", "")
    whole = phonetic.metaphone("".join(words))
    house = (re.findall(r"\d+", address) or [""])[0]
    pin = longest(re.findall(postal, address))
    parts = {
        "exact-name": (country, name), "sorted-tokens": (country, " ".join(sorted(words))),
        "phonetic-set": (country, "|".join(sorted({s for w, s in zip(words, sounds, strict=True) if len(w) > 1}))),
        "full-phonetic": (country, whole), "brand-end": (country, first, last), "core-brand": (country, core_of(name)[:4], first),
        "addr-anchor": (country, house, first), "addr-pin": (country, house, pin), "brand-pin": (country, pin, first),
        "phon-prefix": (country, whole[:5], house), "cross-country": (whole[:6], whole[:6], house),
    }
    return [(k, "|".join(parts[n])) for k, n in enumerate(names) if name and all(parts[n][1:])]


def blocked(norm, names, postal, most=1000, total=60):
    """s1_id to its candidates in order."""
    own = {i: keys_of(*r, names, postal) for i, r in norm.items()}
    pool = defaultdict(list)
    for i in sorted(own):
        if not i.startswith("S1-"):
            for key in own[i]:
                pool[key].append(i)
    out = {}
    for i, keys in own.items():
        if i.startswith("S1-"):
            best = {}
            for k, key in keys:
                if len(pool[k, key]) <= most:
                    for nth, c in enumerate(pool[k, key][: blocking.CAPS[names[k]]]):
                        best[c] = min(best.get(c, (99, 0)), (k, nth))
            out[i] = sorted(best, key=lambda c: (best[c], c))[:total]
    return {i: c for i, c in out.items() if c}


@pytest.mark.parametrize("query, names, postal", [("block_nine_keys", blocking.NINE_KEYS, r"\d{4,}"), ("block_eleven_keys", blocking.ELEVEN_KEYS, r"\b\d{5,6}\b")])
def test_blocking_by_all_keys(spark, query, names, postal):
    got = defaultdict(dict)
    for r in catalogue.queries()[query](spark, SF).collect():
        got[r.s1_id][r["rank"]] = r.cand_id
    want = blocked(plain_norm(spark, short=False), names, postal)
    assert {i: [c[k] for k in sorted(c)] for i, c in got.items()} == want and want


def test_normalized_records_and_sounds(spark):
    raw = {r.entity_id: r for r in catalogue.records(spark, SF).collect()}
    for r in catalogue.queries()["normalized_records"](spark, SF).collect():
        own = raw[r.entity_id]
        for style in text.STYLES:
            assert r[f"name_{style}"] == text.name_form(own.business_name, style)
            assert r[f"addr_{style}"] == text.address_form(own.business_address, style)
    norm = plain_norm(spark, short=False)
    rows = catalogue.queries()["phonetic_codes"](spark, SF).collect()
    assert len(rows) == len(norm)
    for r in rows:
        name = norm[r.entity_id][0]
        assert r.sounds == [phonetic.sound(w) for w in name.split()] and r.whole == phonetic.metaphone(name.replace(" ", ""))


def word_grams(t, low=2, high=4):
    out = []
    for w in t.lower().split():
        padded = f" {w} "
        for n in range(low, high + 1):
            if len(padded) <= n:
                out.append(padded)
                break
            out += [padded[i : i + n] for i in range(len(padded) - n + 1)]
    return out


def similar(norm, grams, max_df, top_k, least):
    """s1_id to [(score, cand_id)] by full vectors."""
    out = {}
    for country in {c for _, _, c in norm.values()}:
        own = {i: Counter(grams(r)) for i, r in norm.items() if r[2] == country}
        pool = [i for i in own if not i.startswith("S1-")]
        df = Counter(g for i in pool for g in own[i])
        idf = {g: math.log((1 + len(pool)) / (1 + n)) + 1 for g, n in df.items() if 2 <= n <= max_df * len(pool)}
        vectors = {}
        for i, counts in own.items():
            w = {g: (1 + math.log(n)) * idf[g] for g, n in counts.items() if g in idf}
            size = math.sqrt(sum(x * x for x in w.values()))
            vectors[i] = {g: x / size for g, x in w.items()}
        for i in own:
            if i.startswith("S1-"):
                scores = [(round(sum(x * vectors[c].get(g, 0.0) for g, x in vectors[i].items()), 6), c) for c in pool]
                kept = sorted(((s, c) for s, c in scores if s > least), key=lambda x: (-x[0], x[1]))[:top_k]
                if kept:
                    out[i] = kept
    return out


def test_tfidf_by_word_grams(spark):
    got = defaultdict(list)
    for r in catalogue.queries()["tfidf_word_grams"](spark, SF).collect():
        got[r.s1_id].append((r["rank"], r.cand_id, r.score))
    want = similar(plain_norm(spark, short=True), lambda r: word_grams(r[0]), 0.05, 50, 0.15)
    assert got.keys() == want.keys() and want
    for i, rows in got.items():
        scores = {c: s for _, c, s in rows}
        assert [s for _, _, s in sorted(rows)] == pytest.approx([s for s, _ in want[i]], abs=2e-6)
        assert all(scores[c] == pytest.approx(s, abs=2e-6) for s, c in want[i] if c in scores)
        assert len({c for _, c in want[i]} ^ scores.keys()) <= 2  # ids of scores that round apart


def tfidf_sides(spark, n=90):
    """Records of three words each, some texts equal, one without a text and one without a country."""
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(25)]
    rows = [(f"S{1 + k % 3}-{k}", ("x", "y")[k % 2], " ".join(rng.choice(words, 3))) for k in range(n)]
    rows = [(i, c, rows[k - 7][2] if k % 5 == 4 and k > 7 else t) for k, (i, c, t) in enumerate(rows)]
    made = spark.createDataFrame([*rows, ("S1-none", "x", None), ("S2-none", None, rows[0][2])], "entity_id string, country string, text string")
    return rows, *catalogue.sides(made)


@pytest.mark.parametrize("blocks", [(8192, 16384), (4, 3)])
def test_tfidf_by_any_number_of_blocks(spark, monkeypatch, blocks):
    monkeypatch.setattr(tfidf, "BLOCK_LEFT", blocks[0])
    monkeypatch.setattr(tfidf, "BLOCK_RIGHT", blocks[1])
    rows, s1, pool = tfidf_sides(spark)
    found = tfidf.similar(s1, pool, 4, 0.15, max_df=0.5)
    got = {(r.s1_id, r["rank"]): (r.score, r.cand_id) for r in found.collect()}
    want = similar({i: (t, "", c) for i, c, t in rows}, lambda r: word_grams(r[0]), 0.5, 4, 0.15)
    assert got.keys() == {(i, k + 1) for i, kept in want.items() for k in range(len(kept))}
    for i, kept in want.items():
        assert [got[i, k + 1][1] for k in range(len(kept))] == [c for _, c in kept]
        assert [got[i, k + 1][0] for k in range(len(kept))] == pytest.approx([x for x, _ in kept], abs=1e-9)


def test_tfidf_goes_through_small_indexes_in_turn(spark, monkeypatch, tmp_path):
    rows, s1, pool = tfidf_sides(spark)
    whole = {(r.s1_id, r["rank"]): r.cand_id for r in tfidf.similar(s1, pool, 4, 0.15, max_df=0.5).where("s1_id != 'S1-none'").collect()}
    grams = lambda side: side.where("country = 'x'").select("country", F.col("entity_id").alias("id"), tfidf.word_grams(F.col("text")).alias("grams"))
    words = tfidf._write_vocabulary(tfidf.fit(grams(pool).withColumnRenamed("id", "entity_id"), max_df=0.5), str(tmp_path))
    dealt = grams(pool).repartitionByRange(9, "id").sortWithinPartitions("id")
    files = tfidf._write_indexes(dealt, words, str(tmp_path), True)["x"]
    made, mine = tfidf.Vectors(words["x"], True), grams(s1).toPandas()
    vectors = made(pa.array([None if g is None else list(g) for g in mine.grams], pa.list_(pa.string())))
    for size in (1, 7, 1000):
        monkeypatch.setattr(tfidf, "BLOCK_RIGHT", size)
        best = tfidf._best_of(vectors, len(mine), files, len(made.words), 4, 0.15)
        got = {(i, k + 1): c for i, (names, _) in zip(mine.id, best, strict=True) for k, c in enumerate(names)}
        assert got == {(i, k): c for (i, k), c in whole.items() if i in set(mine.id)} and got


def test_tfidf_deals_each_text_once(spark):
    """Neither grams nor vectors go through a shuffle: what the tasks exchange is a row for each record of the first source."""
    _, s1, pool = tfidf_sides(spark)
    plan = tfidf.similar(s1, pool, 4, 0.15, max_df=0.5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Generate" not in plan and "CoGroup" not in plan and "Join" not in plan


@pytest.mark.parametrize("name", ["tfidf_topk", "tfidf_best", "tfidf_word_grams"])
def test_tfidf_queries_deal_each_text_once(spark, name):
    plan = catalogue.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Generate" not in plan and "CoGroup" not in plan


@pytest.mark.parametrize("n", [1, 5, 17, 40, 1000])
def test_vocabulary_is_fitted_on_the_first_records_by_hash(spark, n):
    _, _, pool = tfidf_sides(spark)
    rows = pool.where("country is not null")
    order = Window.partitionBy("country").orderBy(F.xxhash64("entity_id"), "entity_id")
    want = rows.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= n).drop("nth")
    assert sorted(r.entity_id for r in tfidf._first_by_hash(rows, n).collect()) == sorted(r.entity_id for r in want.collect())


def test_a_vocabulary_is_fitted_on_all_records(spark):
    n = 100_200
    pool = spark.range(n).select(F.lit("x").alias("country"), F.col("id").cast("string").alias("entity_id"), F.array((F.col("id") % 1002).cast("string")).alias("grams"))
    got = [r.idf for r in tfidf.fit(pool).collect()]
    assert len(got) == 1002 and got == pytest.approx([math.log((1 + n) / 101) + 1] * 1002, abs=1e-12)


@pytest.mark.parametrize("name", ["tfidf_word_grams", "linkage_candidates"])
def test_queries_take_no_sample_for_their_vocabulary(spark, monkeypatch, name):
    monkeypatch.setattr(tfidf, "_first_by_hash", lambda *_: pytest.fail("a sample was taken"))
    catalogue.queries()[name](spark, SF)


def test_candidates_meet_and_are_ranked_after_one_shuffle(spark):
    found = spark.createDataFrame([("S1-1", "S2-1", 0, 1), ("S1-1", "S2-2", 1, 1), ("S1-1", "S2-1", 1, 2)], "s1_id string, cand_id string, key_id int, rank int")
    for made in (blocking.ranked(found), candidates.union_capped(found, found)):
        assert [(r.cand_id, r["rank"]) for r in made.orderBy("rank").collect()] == [("S2-1", 1), ("S2-2", 2)]
        assert made._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_linkage_candidates(spark):
    """TF-IDF's first, then keys', each once, 60 at most."""
    norm = plain_norm(spark, short=True)
    near = similar(norm, lambda r: word_grams(f"{r[0]} {r[0]} {r[1]}"), 0.01, 50, 0.15)
    keys = blocked(norm, blocking.NINE_KEYS, r"\d{4,}")
    got = defaultdict(list)
    for r in catalogue.queries()["linkage_candidates"](spark, SF).collect():
        got[r.s1_id].append((r["rank"], r.from_set, r.cand_id))
    for i in got.keys() | near.keys() | keys.keys():
        first = [c for _, c in near.get(i, [])]
        want = (first + [c for c in keys.get(i, []) if c not in first])[:60]
        assert [c for _, _, c in sorted(got[i])] == want, i


def test_linkage_candidates_of_whole_documents(spark):
    norm = plain_norm(spark, short=False)
    near = similar(norm, lambda r: word_grams(f"{r[0]} {r[0]} {r[1]}"), 0.01, 50, 0.15)
    keys = blocked(norm, blocking.NINE_KEYS, r"\d{4,}")
    got = defaultdict(list)
    for r in catalogue.queries()["linkage_candidates"](spark, SF).collect():
        got[r.s1_id].append((r["rank"], r.cand_id))
    for i in got.keys() | near.keys() | keys.keys():
        first = [c for _, c in near.get(i, [])]
        want = (first + [c for c in keys.get(i, []) if c not in first])[:60]
        assert [c for _, c in sorted(got[i])] == want, i


@pytest.mark.parametrize("once", [40, 1 << 20])
def test_grams_cut_in_numpy_equal_those_of_expressions(spark, monkeypatch, once):
    monkeypatch.setattr(tfidf, "CHARS_AT_ONCE", once)
    texts = ["a bcd", "", " ", None, "Ünï  \tcode 😀😀 x", "aaaa aaaa", "b", "ab cd\nef ", "\x00 \x00a\x00", "word " * 30]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, t string").coalesce(1)
    want = [Counter(r.g or []) for r in df.select("n", tfidf.word_grams(F.col("t")).alias("g")).orderBy("n").collect()]
    column = pa.array([r.g for r in df.select("n", tfidf.spaced(F.col("t")).alias("g")).orderBy("n").collect()], pa.string())
    got = [Counter() for _ in texts]
    for low, size in tfidf._slices(column):
        record, gram, tf, words = tfidf._counted(column.slice(low, size))
        for i, g, n in zip(record + low, gram, tf, strict=True):
            got[i][words[int(g)].as_py()] += int(n)
    assert got == want


def jaccard(a, b, both_empty=0.0):
    return len(a & b) / len(a | b) if a or b else both_empty


def overlap(a, b, least):
    return len(a & b) / (min if least else max)(len(a), len(b)) if a and b else 0.0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def grams3(t):
    return {t[i : i + 3] for i in range(max(1, len(t) - 2))} if t else set()


def plain_features(one, two, cand_id, idf):
    """All features of all versions of a pair (name, address, country), by name."""
    (n1, a1, c1), (n2, a2, c2) = one, two
    scores = {"ratio": fuzzy.ratio, "partial_ratio": fuzzy.partial_ratio, "token_sort": fuzzy.token_sort_ratio, "token_set": fuzzy.token_set_ratio, "WRatio": fuzzy.weighted_ratio, "jw": fuzzy.jaro_winkler, "lcs_ratio": fuzzy.lcs_ratio}
    out = {f"{of}_{k}": f(*pair) for of, pair in (("name", (n1, n2)), ("addr", (a1, a2))) for k, f in scores.items()}
    t1, t2, s1, s2 = (set(x.split()) for x in (n1, n2, a1, a2))
    first1, first2 = ((x.split() or [""])[0] for x in (n1, n2))
    digits = lambda a: set(re.findall(r"\b[0-9]+\b", a))
    house1, house2 = ((re.findall(r"\d+", a) or [""])[0] for a in (a1, a2))
    pin1, pin2 = (longest(re.findall(r"\d{4,}", a)) for a in (a1, a2))
    edit = lambda x, y: 1 - distance(x, y) / max(len(x), len(y)) if x and y else 0.0
    apart = lambda x, y: abs(len(x) - len(y)) / max(len(x), len(y), 1)
    sounds1, sounds2 = ({phonetic.sound(w) for w in x.split() if len(w) > 1} for x in (n1, n2))
    core1, core2 = core_of(n1), core_of(n2)
    weight = lambda words: sum(idf.get(w, 1.0) for w in words)
    heavy = lambda x, y: weight(x & y) / max(weight(x | y), 1e-5) if x and y else 0.0
    return out | {
        "name_jaccard": jaccard(t1, t2), "name_overlap_min": overlap(t1, t2, True), "name_overlap_max": overlap(t1, t2, False),
        "addr_jaccard": jaccard(s1, s2), "addr_overlap_min": overlap(s1, s2, True), "name_len_diff": apart(n1, n2), "addr_len_diff": apart(a1, a2),
        "name1_empty": n1 == "", "name2_empty": n2 == "", "addr1_empty": a1 == "", "addr2_empty": a2 == "", "country_match": c1 == c2,
        "first_word_match": bool(first1) and first1 == first2, "first_word_sim": fuzzy.ratio(first1, first2) if first1 and first2 else 0.0,
        "num_jaccard": jaccard(digits(a1), digits(a2), 1.0), "is_s3": cand_id.startswith("S3"), "name_lev": edit(n1, n2), "addr_lev": edit(a1, a2),
        "name_gram3": jaccard(grams3(n1), grams3(n2)), "addr_gram3": jaccard(grams3(a1), grams3(a2)),
        "name_phon_exact": bool(sounds1) and sounds1 == sounds2, "name_phon_jaccard": jaccard(sounds1, sounds2),
        "house_match": bool(house1) and house1 == house2, "pin_match": bool(pin1) and pin1 == pin2,
        "house_mismatch_penalty": bool(house1 and house2) and house1 != house2, "pin_mismatch_penalty": bool(pin1 and pin2) and pin1 != pin2,
        "same_street_diff_house": jaccard(s1, s2) > 0.6 and bool(house1 and house2) and house1 != house2,
        "core_name_ratio": fuzzy.ratio(core1, core2) if core1 and core2 else 0.0, "core_name_jaccard": jaccard(set(core1.split()), set(core2.split())),
        "weighted_name_jaccard": heavy(t1, t2), "weighted_addr_jaccard": heavy(s1, s2),
    }


@pytest.mark.parametrize("version", features.FEATURES)
def test_features_of_all_candidates(spark, version):
    norm = plain_norm(spark, short=True)
    firsts = [r for i, r in norm.items() if i.startswith("S1-")]
    df = Counter(w for name, *_ in firsts for w in set(name.split()))
    idf = {w: math.log((len(firsts) + 1) / (n + 1)) + 1 for w, n in df.items()}
    rows = catalogue.queries()[f"features_{version}"](spark, SF).collect()
    pairs = {(r.s1_id, r.cand_id) for r in catalogue.queries()["linkage_candidates"](spark, SF).collect()}
    assert {(r.s1_id, r.cand_id) for r in rows} == pairs and len(rows) == len(pairs) > 0
    for r in rows:
        want = plain_features(norm[r.s1_id], norm[r.cand_id], r.cand_id, idf)
        for name in features.FEATURES[version]:
            assert r[name] == pytest.approx(float(want[name]), abs=1e-9), (name, r.s1_id, r.cand_id)


@pytest.fixture(scope="module")
def whole_pairs(spark):
    """The candidates of whole documents, and all features of those that plain code compares soonest."""
    norm = plain_norm(spark, short=False)
    firsts = [r for i, r in norm.items() if i.startswith("S1-")]
    df = Counter(w for name, *_ in firsts for w in set(name.split()))
    idf = {w: math.log((len(firsts) + 1) / (n + 1)) + 1 for w, n in df.items()}
    pairs = {(r.s1_id, r.cand_id) for r in catalogue.queries()["linkage_candidates"](spark, SF).collect()}
    cells = lambda p: max(len(norm[p[0]][k]) * len(norm[p[1]][k]) for k in (0, 1))
    soonest = sorted((p for p in pairs if cells(p) > 200**2), key=lambda p: (cells(p), p))[:8]
    assert len(soonest) == 8 and all(norm[i][1] != norm[c][1] for i, c in soonest[:1])
    return pairs, {p: plain_features(norm[p[0]], norm[p[1]], p[1], idf) for p in soonest}


@pytest.mark.parametrize("version", features.FEATURES)
def test_features_of_whole_documents(spark, whole_pairs, version):
    pairs, want = whole_pairs
    rows = {(r.s1_id, r.cand_id): r for r in catalogue.queries()[f"features_{version}"](spark, SF).collect()}
    assert rows.keys() == pairs
    for p, own in want.items():
        for name in features.FEATURES[version]:
            assert rows[p][name] == pytest.approx(float(own[name]), abs=1e-9), (name, p)


def test_a_core_name_that_is_the_whole_name_is_not_sent_twice(spark):
    pool = spark.createDataFrame([("S2-1", "alder mill", "alder mill"), ("S2-2", "alder mill ltd", "alder mill"), ("S2-3", "ltd", ""), ("S2-4", None, None)], "entity_id string, name_norm string, core_name string")
    sent = features._sent(features.plain_side(pool, 2, "v3"))
    assert [r.core2 for r in sent.orderBy("entity_id2").collect()] == [None, "alder mill", "", None]
    assert [r.core2 for r in features._received(sent).orderBy("entity_id2").collect()] == ["alder mill", "alder mill", "", ""]


def test_approximate_counts_are_close(spark):
    table = catalogue.table(spark, SF, "lineitem")
    exact = {r.column_name: r.distinct_count for r in profile.missing_distinct(table).collect()}
    for r in catalogue.queries()["profile_approx_distinct"](spark, SF).collect():
        assert r.distinct_count == pytest.approx(exact[r.column_name], rel=0.15, abs=2)


def test_boosted_scores_tell_true_pairs_apart(spark):
    rows = catalogue.plain_records(spark, SF)
    true = {(r.s1_id, r.cand_id) for r in catalogue.truth(rows).collect()}
    scored = {(r.s1_id, r.cand_id): r.prob for r in catalogue.queries()["gbt_score"](spark, SF).collect()}
    inside = [p for k, p in scored.items() if k in true]
    assert inside and min(inside) > max(p for k, p in scored.items() if k not in true and p < 0.5)
    assert all(0 <= p <= 1 for p in scored.values())


def test_quantiles_equal_sorting(spark):
    rng = np.random.default_rng(5)
    columns = {"normal": rng.normal(size=3000), "ties": rng.integers(0, 4, 3000).astype(float), "wide": 10.0 ** rng.uniform(-300, 300, 3000), "one": np.full(3000, 7.0)}
    rows = [tuple(float(c[k]) for c in columns.values()) + ((None, float("nan"), float("inf"))[k % 3],) for k in range(3000)]
    df = spark.createDataFrame(rows, "normal double, ties double, wide double, one double, none double")
    got = profile.quantiles(df, df.columns)
    for own, c in zip(got, columns.values(), strict=False):
        assert own == pytest.approx(np.quantile(c, profile.QUANTILES).tolist(), rel=1e-12)
    assert got[-1] == [None, None, None]
    assert profile.numeric_stats(df.limit(0)).select(F.count("median")).first()[0] == 0
