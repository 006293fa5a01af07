import random
from collections import Counter, defaultdict

import brute
import numpy as np
import pyarrow as pa
import pytest

from tallyweave.llm import common, dartminhash


def signatures(texts):
    raw, at = common.utf8(pa.array(texts))
    text, hashes = dartminhash.shingles(raw, at)
    return dartminhash.signatures(text, hashes, len(texts))


def classes_by_brute_force(rows):
    """(doc_id, class_id) counts by comparing all pairs that share a shingle."""
    bags = [brute.shingles((t or "").lower()) for _, t in rows]
    index = defaultdict(list)
    for i, bag in enumerate(bags):
        for s in bag:
            index[s].append(i)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in {(v[j], v[i]) for v in index.values() for i in range(len(v)) for j in range(i)}:
        if find(a) != find(b) and brute.similarity(bags[a], bags[b]) >= 0.8:
            root[find(a)] = find(b)
    groups = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        groups[find(i)].append(doc_id)
    least = {r: min((x for x in ids if x is not None), default=None) for r, ids in groups.items()}
    return Counter((doc_id, least[find(i)]) for i, (doc_id, _) in enumerate(rows))


def test_signatures_estimate_weighted_similarity():
    random.seed(3)
    words = [f"w{i}" for i in range(3000)]
    off = []
    for trial in range(40):
        a = [random.choice(words) for _ in range(random.choice([8, 30, 100, 400, 1500]))]
        if trial % 3 == 0:
            a = a + a[: len(a) // 2] + [a[0]] * random.randint(0, 200)
        b = list(a)
        for _ in range(random.randint(1, max(1, len(a) // 15))):
            b[random.randrange(len(b))] = str(random.random())
        one, two = " ".join(a), " ".join(b)
        s = signatures([one, two, ""])
        off.append((s[0] == s[1]).mean() - brute.similarity(brute.shingles(one), brute.shingles(two)))
    assert abs(np.mean(off)) < 0.02
    assert np.abs(off).max() < 0.15


def edge_rows():
    base = "a b c d e f g h i j k l m n o p q r s t u v w x y z " * 3
    texts = [None, "", " ", "x", "x", "x y", "X y", base, base + "more", base.replace("k", "kk"), "one two three", "one two three four"]
    rows = list(enumerate(texts))
    return rows + [(50, base), (50, "other text entirely of five words more"), (None, base), (None, "null id only here text"), (None, "null id only here text")]


def large_group_rows(n=420):
    """Near copies of one text by few to many edits, and documents around one passage."""
    random.seed(11)
    words = [f"v{i}" for i in range(4000)]
    base = [random.choice(words) for _ in range(150)]
    rows = [(1000, " ".join(base))]
    for k in range(n):
        copy = list(base)
        for _ in range(random.randint(0, 9)):
            place = random.randrange(len(copy))
            copy[place : place + 1] = random.choice([[random.choice(words)], [], [copy[place], random.choice(words)]])
        rows.append((1001 + k, " ".join(copy)))
    passage = [random.choice(words) for _ in range(60)]
    for k in range(n // 2):
        around = [random.choice(words) for _ in range(random.randint(0, 40))]
        cut = random.randint(0, len(around))
        rows.append((5000 + k, " ".join(around[:cut] + passage + around[cut:])))
    return rows


@pytest.mark.parametrize("rows", [edge_rows(), large_group_rows()], ids=["edges", "large groups"])
def test_classes_equal_brute_force(spark, rows):
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, class_id string")
    found = Counter((r.doc_id, r.class_id) for r in dartminhash.classes(df).collect())
    assert found == classes_by_brute_force(rows)


def test_large_groups_cost_few_comparisons(spark, monkeypatch):
    rows = large_group_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    compared, compare = [], dartminhash.compare
    monkeypatch.setattr(dartminhash, "compare", lambda pairs, *rest: compared.append(pairs.count()) or compare(pairs, *rest))
    dartminhash.classes(df).count()
    assert sum(compared) < 30 * len(rows)


def test_representatives_keep_one_of_each_class(spark):
    rows = edge_rows()
    df = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, gone int")
    kept = dartminhash.representatives(df)
    assert kept.columns == df.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids == Counter({0: 1, 1: 1, 2: 1, 3: 1, 5: 1, 7: 1, 9: 1, 10: 1, 11: 1, 50: 1, None: 1}), ids
    assert [r.text for r in kept.collect() if r.doc_id == 50] == ["other text entirely of five words more"]


def test_representatives_lose_no_text_by_a_shared_id(spark):
    text = "this text stands in the table under two ids and once more with another source"
    other = "quite another text that shares the id of the copy but none of its words at all"
    rows = [(1, text, "a"), (2, text, "a"), (2, other, "a"), (3, other + " and more words than that by far", "b"), (4, text, "c"), (4, text, "c"), (5, other, "z"), (0, "own words here", "s"), (0, "own words here", "r")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = sorted((r.doc_id, r.text) for r in dartminhash.representatives(df).collect())
    assert kept == sorted([(0, "own words here"), (1, text), (2, other), (3, rows[3][1])]), kept


def test_recall_against_all_pairs(spark):
    """Of the rows whose id is divisible by 20, all near pairs with any row are in one class."""
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    found = {r.doc_id: r.class_id for r in dartminhash.classes(docs).collect()}
    bags = [brute.shingles((t or "").lower()) for _, t in rows]
    near = [(rows[i][0], rows[j][0]) for i in range(len(rows)) if rows[i][0] % 20 == 0 and bags[i] for j in range(len(rows)) if i != j and bags[j] and brute.similarity(bags[i], bags[j]) >= 0.8]
    assert near and sum(found[a] == found[b] for a, b in near) >= 0.9 * len(near)
    assert all(found[a] == found[b] for a, b in near)


def test_very_long_text(spark):
    random.seed(4)
    words = [random.choice("abcdefghijklmnopqrstuvwxyz") * random.randint(1, 6) + str(random.randint(0, 9999)) for _ in range(400_000)]
    long, cut = " ".join(words), " ".join(words[:350_000])
    df = spark.createDataFrame([(1, long), (2, cut), (3, "short text of some words here")], "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in dartminhash.classes(df).collect()} == {1: 1, 2: 1, 3: 3}


@pytest.mark.parametrize("small", [10**6, 0], ids=["one task", "stars"])
def test_components(spark, monkeypatch, small):
    random.seed(6)
    edges = [(k, k + 1) for k in range(40)] + [(100 + random.randrange(30), 100 + random.randrange(30)) for _ in range(25)] + [(500, k) for k in range(501, 540)]
    monkeypatch.setattr(dartminhash, "SMALL_GRAPH", small)
    found = {r.node: r.label for r in dartminhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {n: n for e in edges for n in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    loose = {a for a, b in edges if a == b} - {n for a, b in edges if a != b for n in (a, b)}
    assert found == {n: find(n) for n in root if n not in loose}


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert dartminhash.classes(df).collect() == []
    assert dartminhash.representatives(df).collect() == []
