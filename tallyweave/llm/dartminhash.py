"""Near-duplicates by DartMinHash signatures and banded joins, with every candidate checked and no group taken whole.

A document is the multiset of its runs of five words (fewer, if it has fewer), A-Z in lower case. Two documents are near
when the weighted Jaccard similarity of these multisets, sum of minima over sum of maxima, is SIMILARITY or more. Classes
are the connected components of near documents.

Signatures follow T. Christiani, "DartMinHash: Fast Sketching for Weighted Sets" (2020). The plane of weight and rank over
each element is cut into regions that double in both directions, and each region into cells of equal area; a hash of
element and cell says how many darts have hit a cell (Poisson with mean 1) and where. A document keeps the darts below
its weights and below a bound on rank that lets about K ln K + 2 K through, whatever its length; each dart belongs to one of
K coordinates by its hash, and a coordinate's value is its dart of least rank. The bound is raised for the few documents
with an empty coordinate.

Bands of ROWS coordinates make candidates; BANDS are so many that a pair at SIMILARITY shares none with probability below
1e-5. Documents of equal multisets are one node. The nodes of a band's value are a bucket, and candidates are checked on
the elements of their texts: the runs, each with the number of its occurrence, so that the sum of minima is the size of
an intersection.

In buckets of up to SMALL nodes all pairs are compared. In a larger bucket each node is compared with one hub, the node
that meets most others in large buckets, which for near copies is the text that they were made from or close to it. What
a hub leaves in several components is closed by a prefix join, once for all nodes of such buckets: their elements are
ordered from rare to frequent among these nodes, and x and y can only share threshold / (1 + threshold) * (|x| + |y|)
elements if the first that they share has so many behind it, itself included, in both. Entries (element, node) that no
other size in the element's list allows go first, then lists of a single component; of the others, entries outside the
list's largest component meet all. So no near pair of a bucket is passed over unless its nodes are connected already, and
a large group of near copies costs each node one comparison and a few entries.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.llm import common
from tallyweave.llm.decontam import window_hashes

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 30, 5
K = BANDS * ROWS
DARTS = K * math.log(K) + 2 * K
#: Buckets of up to so many nodes are compared in pairs; larger ones by way of a hub and the prefix join.
SMALL = 16
#: Up to so many ids are broadcast to pick the texts that a comparison needs; more are joined by a shuffle of all texts.
BROADCAST_IDS = 500_000
#: A graph of up to so many edges is solved in one task.
SMALL_GRAPH = 500_000
#: Texts whose darts are thrown at once.
AT_ONCE = 192

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.ones(256, bool)
_WORD[[32, 9, 10, 11, 12, 13]] = False
_U = np.uint64
#: Distribution function of the Poisson distribution with mean 1.
_POISSON = np.cumsum([math.exp(-1) / math.factorial(n) for n in range(16)])


def shingles(raw: np.ndarray, at: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The text number and the 64-bit hash of each run of `words` words; a text of fewer words, but not none, is one run."""
    base, n = int(at[0]), len(at) - 1
    room = np.full(int(at[-1]) - base + n, 32, np.uint8)
    inside = np.ones(len(room), bool)
    inside[at[1:] - base + np.arange(n)] = False
    room[inside] = raw[base : int(at[-1])]
    lower = _LOWER[room]
    starts, ends = common.runs(_WORD[lower])
    hashes = common.word_hashes(lower, starts, ends)
    border = np.searchsorted(starts, at - base + np.arange(n + 1))
    count = np.diff(border)
    text = np.repeat(np.arange(n), count)
    long = np.flatnonzero(text[: len(text) - words + 1] == text[words - 1 :]) if len(text) >= words else np.zeros(0, np.int64)
    texts, found = [text[long]], [window_hashes(hashes, words)[long]]
    for k in range(1, words):
        few = np.flatnonzero(count == k)
        if len(few):
            texts.append(few)
            found.append(common.mix64(window_hashes(hashes, k)[border[few]] + _U(k)))
    return np.concatenate(texts), np.concatenate(found)


def weighted(text: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys, text number in the upper 20 bits and 44 bits of hash below, and how often each stands there."""
    keys = np.sort(text.astype(np.uint64) << _U(44) | hashes >> _U(20))
    first = np.flatnonzero(np.diff(keys, prepend=keys[:1] + _U(1)) != 0) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(first, append=len(keys))


def darts(element: np.ndarray, weight: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The darts below each element's weight and rank bound: the element's place, the dart's hash, its rank.

    Weights are in units of which one holds one dart up to rank 1, so regions begin at 2^n - 1 in weight as in rank.
    """
    where, hashes, ranks = [], [], []
    most_weight, most_rank = float(weight.max(initial=0)), float(bound.max(initial=0))
    nu = 0
    while 2**nu - 1 < most_weight:
        heavy = np.flatnonzero(weight > 2**nu - 1)
        rho = 0
        while 2**rho - 1 < most_rank:
            own = heavy[bound[heavy] > 2**rho - 1]
            rho += 1
            if not len(own):
                continue
            width, height = 2.0 ** (nu - rho + 1), 2.0 ** (rho - 1 - nu)
            low_w, low_r = float(2**nu - 1), float(2 ** (rho - 1) - 1)
            n_w = np.minimum(2 ** (rho - 1), np.ceil((weight[own] - low_w) / width)).astype(np.int64)
            n_r = np.minimum(2**nu, np.ceil((bound[own] - low_r) / height)).astype(np.int64)
            cells = n_w * n_r
            of = np.repeat(np.arange(len(own)), cells)
            cell = np.arange(len(of)) - np.repeat(np.cumsum(cells) - cells, cells)
            w, r = np.divmod(cell, n_r[of])
            place = _U((nu << 8 | rho) * 0xC2B2AE3D27D4EB4F & (1 << 64) - 1) + w.astype(np.uint64) * _U(0x9E3779B185EBCA87) + r.astype(np.uint64) * _U(0x165667B19E3779F9)
            h = common.mix64(element[own[of]] ^ common.mix64(place))
            hits = np.searchsorted(_POISSON, (h >> _U(11)).astype(np.float64) * 2.0**-53, "right")
            for j in range(int(hits.max(initial=0))):
                hit = np.flatnonzero(hits > j)
                dart = common.mix64(h[hit] + _U(j + 1))
                up = low_w + (w[hit] + (dart >> _U(32)).astype(np.float64) * 2.0**-32) * width
                rank = low_r + (r[hit] + (dart & _U(0xFFFFFFFF)).astype(np.float64) * 2.0**-32) * height
                e = own[of[hit]]
                kept = (up < weight[e]) & (rank < bound[e])
                where.append(e[kept])
                hashes.append(dart[kept])
                ranks.append(rank[kept])
        nu += 1
    return (np.concatenate(where), np.concatenate(hashes), np.concatenate(ranks)) if where else (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0))


def signatures(text: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """n rows of K coordinates; the rows of texts without a shingle are 0."""
    keys, count = weighted(text, hashes)
    own = (keys >> _U(44)).astype(np.int64)
    element = common.mix64(keys & _U((1 << 44) - 1))
    total = np.bincount(own, count, n)
    out = np.zeros((n, K), np.uint64)
    open_, theta = total > 0, 1.0
    while open_.any():
        use = np.flatnonzero(open_[own])
        bound = theta * DARTS / total[own[use]]
        e, dart, rank = darts(element[use], count[use].astype(np.float64), bound)
        coordinate = own[use[e]] * K + (common.mix64(dart ^ _U(0x5851F42D4C957F2D)) % _U(K)).astype(np.int64)
        order = np.argsort(coordinate.astype(np.uint64) << _U(32) | rank.astype(np.float32).view(np.uint32).astype(np.uint64), kind="stable")
        coordinate = coordinate[order]
        first = order[np.flatnonzero(np.diff(coordinate, prepend=-1))]
        filled = np.unique(coordinate)
        full = np.bincount(filled // K, minlength=n) == K
        done = np.flatnonzero(full[filled // K])
        out.reshape(-1)[filled[done]] = dart[first[done]]
        open_ &= ~full
        theta *= 1.5
    return out


def bands(signature: np.ndarray) -> np.ndarray:
    """A hash for each band of each row."""
    rows = signature.reshape(len(signature), BANDS, ROWS)
    h = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * _U(0x9E3779B97F4A7C15)
    for r in range(ROWS):
        h = common.mix64(h ^ rows[:, :, r])
    return h


SIGNATURE = "doc_id long, h long, node long, print long, size long, bands array<long>"


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, at = common.utf8(batch.column(1))
        for low, high in common.slices(at):
            for begin in range(low, high, AT_ONCE):
                end = min(high, begin + AT_ONCE)
                n = end - begin
                text, hashes = shingles(raw, at[begin : end + 1])
                size = np.bincount(text, minlength=n)
                some = size > 0
                node, other = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
                np.add.at(node, text, common.mix64(hashes))
                np.add.at(other, text, common.mix64(hashes ^ _U(0xD6E8FEB86659FD93)))
                found = bands(signatures(text, hashes, n)).view(np.int64)
                none = pa.array(~some)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), pa.array(found.reshape(-1)), mask=none)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, n), batch.column(2).slice(begin, n), pa.array(node.view(np.int64), mask=~some), pa.array(other.view(np.int64), mask=~some), pa.array(size.astype(np.int64)), lists], names=["doc_id", "h", "node", "print", "size", "bands"])


ELEMENTS = "node long, elements array<long>"


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The elements of each text: a hash of a run and of the number of its occurrence, so none stands twice."""
    for batch in batches:
        raw, at = common.utf8(batch.column("text"))
        for low, high in common.slices(at):
            n = high - low
            keys, count = weighted(*shingles(raw, at[low : high + 1]))
            own = np.repeat(keys, count)
            nth = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
            found = common.mix64((own & _U((1 << 44) - 1)) + nth.astype(np.uint64) * _U(1 << 44)).view(np.int64)
            border = np.searchsorted(own >> _U(44), np.arange(n + 1, dtype=np.uint64)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(border), pa.array(found))
            yield pa.RecordBatch.from_arrays([batch.column("node").slice(low, n), lists], names=["node", "elements"])


def _same_row(doc_id: str, h: str) -> Column:
    return F.col("doc_id").eqNullSafe(F.col(doc_id)) & F.col("h").eqNullSafe(F.col(h))


def _shelf(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, elements and size of the nodes `wanted` (node, at), from the texts of their rows.

    The texts are picked by a broadcast of the rows' ids where those are counted to be few, else by a shuffle. Repeated
    rows meet by node, with one text for each task at most.
    """
    named = wanted.select("node", F.col("at.id").alias("id"), F.col("at.h").alias("its"))
    few = named.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    texts = rows.join(F.broadcast(named) if few else named, _same_row("id", "its")).select("node", "text")
    found = texts.dropDuplicates(["node"]).mapInArrow(common.released(_elements), ELEMENTS)
    return common.checkpoint(found.select("node", "elements", F.size("elements").alias("size")))


def _sizes_allow(a: str, b: str, threshold: float) -> Column:
    return F.least(a, b) >= threshold * F.greatest(a, b) - 1e-9


def compare(pairs: DataFrame, shelf: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) of nodes that are near, by their elements."""
    first = pairs.join(shelf.toDF("a", "elements_a", "size_a"), "a")
    both = first.join(shelf.toDF("b", "elements_b", "size_b"), "b").where(_sizes_allow("size_a", "size_b", threshold))
    shared = F.size(F.array_intersect("elements_a", "elements_b"))
    near = shared >= threshold * (F.col("size_a") + F.col("size_b") - shared) - 1e-9
    return common.checkpoint(both.where(near).select("a", "b"))


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The components of all edges (u, v): least neighbours and jumps to the label's label, until nothing changes."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if len(b)]
    if not parts:
        return
    u, v = (np.concatenate(x) for x in zip(*parts, strict=True))
    nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = place[: len(u)], place[len(u) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], names=["node", "label"])


def components(edges: DataFrame) -> DataFrame:
    """node, label of each node of an edge, the label being the least node of its component.

    The edges are counted first. Up to SMALL_GRAPH of them are solved in one task of an executor. More are solved by large
    stars and small stars in turn (R. Kiveris et al., "Connected Components in MapReduce and Beyond", 2014): each round reads
    and writes edges alone, with sums by node before they are dealt, until nothing changes.
    """

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = common.checkpoint(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    if now.count() <= SMALL_GRAPH:
        return common.checkpoint(now.coalesce(1).mapInArrow(_solve, "node long, label long"))
    seen = state(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now = common.checkpoint(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
        if (new := state(now)) == seen:
            break
        seen = new
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def _once(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) once each, whichever way around; the way that one of them has stays."""
    one = pairs.groupBy(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(F.first(F.struct("a", "b")).alias("p"))
    return one.select("p.a", "p.b")


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """`label` beside each row of a node; a node without an edge is its own."""
    return rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def _closing(large: DataFrame, labels: DataFrame, shelf: DataFrame, threshold: float) -> DataFrame | None:
    """Pairs (a, b) of nodes in different components of one large bucket (key, node) that may be near, by a prefix join."""
    share = threshold / (1 + threshold)
    members = common.checkpoint(_labelled(large.select("key", "node"), labels))
    several = common.checkpoint(members.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key"))
    open_ = common.checkpoint(members.join(several, "key", "left_semi").select("node", "label").distinct())
    if open_.isEmpty():
        return None
    exploded = open_.join(shelf, "node").select("node", "label", "size", F.explode("elements").alias("element"))
    often = common.checkpoint(exploded.groupBy("element").agg(F.count("*").alias("often")).where("often > 1"))
    # an element that no other node has comes first in the order and in no list; `rest` counts those from one on
    order = Window.partitionBy("node").orderBy(F.desc("often"), "element")
    entries = exploded.join(often, "element").withColumn("rest", F.row_number().over(order))
    entries = common.checkpoint(entries.where(F.col("rest") >= threshold * F.col("size") - 1e-9).drop("often"))
    for _ in range(2):
        of_label = entries.groupBy("element", "label").agg(F.count("*").alias("n"), F.min("size").alias("least"))
        of_list = of_label.groupBy("element").agg(F.max(F.struct("n", "label")).alias("most"), F.min("least").alias("least"), F.count("*").alias("labels"))
        of_list = common.checkpoint(of_list.where("labels > 1").select("element", "least", F.col("most.label").alias("main")))
        partner = F.greatest(F.col("least").cast("double"), threshold * F.col("size"))
        entries = entries.select("element", "node", "label", "size", "rest").join(of_list, "element").where(F.col("rest") >= share * (F.col("size") + partner) - 1e-9)
        entries = common.checkpoint(entries.drop("least"))
    one = entries.where("label <> main").select("element", F.col("node").alias("a"), F.col("label").alias("of_a"), F.col("size").alias("n_a"), F.col("rest").alias("rest_a"))
    other = entries.select("element", F.col("node").alias("b"), F.col("label").alias("of_b"), F.col("size").alias("n_b"), F.col("rest").alias("rest_b"))
    enough = F.least("rest_a", "rest_b") >= share * (F.col("n_a") + F.col("n_b")) - 1e-9
    met = one.join(other, (one["element"] == other["element"]) & (F.col("of_a") != F.col("of_b")) & enough)
    return common.checkpoint(_once(met.select("a", "b")))


def near_labels(buckets: DataFrame, nodes: DataFrame, rows: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """node, label: the components of near nodes among those that share a bucket (key, node).

    nodes has node, size and `at`, the id and the hash of the text of a row that is the node; rows has all rows.
    """
    spark = nodes.sparkSession
    sized = buckets.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = common.checkpoint(buckets.join(sized, "key").join(nodes.select("node", "size", "at"), "node"))
    common.forget(spark)
    small = members.where(F.col("n") <= SMALL).select("key", "node", "size")
    pairs = small.toDF("key", "a", "size_a").join(small.toDF("key", "b", "size_b"), "key").where((F.col("a") < F.col("b")) & _sizes_allow("size_a", "size_b", threshold)).select("a", "b")
    large = members.where(F.col("n") > SMALL)
    crowded = not large.isEmpty()
    if crowded:
        meets = large.groupBy("node").agg(F.sum("n").alias("meets"))
        hubs = common.checkpoint(large.join(meets, "node").groupBy("key").agg(F.max(F.struct("meets", "node", "size")).alias("hub")))
        star = large.select("key", "node", "size").join(hubs.select("key", F.col("hub.node").alias("a"), F.col("hub.size").alias("size_a")), "key")
        star = star.where((F.col("node") != F.col("a")) & _sizes_allow("size", "size_a", threshold)).select("a", F.col("node").alias("b"))
        pairs = pairs.unionByName(star.distinct())
    pairs = common.checkpoint(_once(pairs))
    compared = pairs.select(F.explode(F.array("a", "b")).alias("node"))
    wanted = (compared.unionByName(large.select("node")) if crowded else compared).distinct()
    shelf = _shelf(rows, common.checkpoint(wanted.join(nodes.select("node", "at"), "node")))
    edges = compare(pairs, shelf, threshold)
    labels = components(edges)
    common.forget(spark)
    left = _closing(large, labels, shelf, threshold) if crowded else None
    if left is None or left.isEmpty():
        return labels
    return components(edges.unionByName(compare(left, shelf, threshold)))


def _classified(docs: DataFrame, threshold: float, id_col: str, text_col: str) -> DataFrame:
    """doc_id, h (a hash of the text) and `best` of each row: the id and the h of its class's first row, null where the text has no word."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    signed = common.checkpoint(rows.mapInArrow(common.released(_signed), SIGNATURE))
    worded = signed.where("node is not null")
    # equal multisets: one node, with sums before the exchange, so a large group of copies is one row for each task
    at = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "h")
    nodes = common.checkpoint(worded.groupBy("node", "print").agg(F.min(at).alias("at"), F.first("size").alias("size"), F.first("bands").alias("bands")))
    labels = near_labels(nodes.select("node", F.explode("bands").alias("key")), nodes, rows, threshold)
    best = common.checkpoint(labels.join(nodes.select("node", "at"), "node").groupBy("label").agg(F.min("at").alias("best")))
    linked = common.checkpoint(labels.join(best, "label").select("node", "best"))
    of_node = nodes.select("node", "print", "at").join(linked, "node", "left").select(F.col("node").alias("n"), F.col("print").alias("p"), F.coalesce("best", "at").alias("best"))
    found = worded.select("doc_id", "h", "node", "print").join(common.checkpoint(of_node), (F.col("node") == F.col("n")) & (F.col("print") == F.col("p")))
    return found.select("doc_id", "h", "best").unionByName(signed.where("node is null").select("doc_id", "h", F.lit(None).cast(found.schema["best"].dataType).alias("best")))


def classes(docs: DataFrame, threshold: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and class_id, the least doc_id of the class, of each row.

    A text that is null or has no word is like no other, and its class is its own id. Repeated rows are one class. Rows
    with a null id take part; a class of nothing else has a null class_id. Where an id stands at several texts, each text
    has its own class, so an id can have several rows with different classes.
    """
    found = _classified(docs, threshold, id_col, text_col)
    return found.select("doc_id", F.when(F.col("best").isNull(), F.col("doc_id")).otherwise(F.col("best.id")).alias("class_id"))


def representatives(docs: DataFrame, threshold: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class of `docs`, columns as they are: that with the least id, nulls last, then the least hash of its text.

    Rows are told apart by id and text, so a text whose id stands at another class's text too stays. Of several rows
    with that id and that text the one with the least hash of its columns stays. Rows without a word stay, all of them.
    """
    found = common.checkpoint(_classified(docs, threshold, id_col, text_col))
    chosen = F.col("doc_id").eqNullSafe(F.col("best.id")) & (F.col("h") == F.col("best.h"))
    worded = found.where("best is not null")
    gone = worded.where(~chosen).select(F.col("doc_id").alias("__id"), F.col("h").alias("__h")).distinct()
    row_id, row_h = F.col(f"`{id_col}`").cast("long"), F.xxhash64(F.col(f"`{text_col}`").cast("string"))
    kept = docs.join(gone, row_id.eqNullSafe(F.col("__id")) & (row_h == F.col("__h")), "left_anti")
    again = common.checkpoint(worded.where(chosen).groupBy(F.col("doc_id").alias("__id"), F.col("h").alias("__h")).count().where("count > 1").drop("count"))
    if again.isEmpty():
        return kept
    same = row_id.eqNullSafe(F.col("__id")) & (row_h == F.col("__h"))
    several = kept.join(again, same).groupBy("__id", "__h")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    hashed = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    one = several.agg(F.min_by(F.struct(*columns), F.xxhash64(*hashed)).alias("__row")).select("__row.*")
    return kept.join(again, same, "left_anti").unionByName(one)
