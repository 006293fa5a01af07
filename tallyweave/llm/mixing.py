"""Mixing sources to target weights by a minimum-cost flow.

Documents are first counted by membership pattern, the set of sources that may claim them. A flow network has a node for
each pattern and each source. A pattern gives its words up to `max_repeats` times; the first pass over them is free and
each further one costs one more than the last, so repetition is spread before it is deepened. A source takes up to its
quota. The cheapest flow that fills the quotas says how many words each pattern gives. As costs stand on a pattern's passes
alone, it is found by one largest flow after another: with first passes only, then with second ones, and so on.

Whole passes go to all of a pattern's documents. What is missing beyond them is given by whole documents. First each size
class, from a power of two to the next, gives its share in the order of a seeded hash, to the nearest document. What is then
missing or too much is mended in rounds, each with a new order, among the documents not taken, or taken, that are no
larger: one that has half of it or more changes, or else those that come first in the order do. So it halves from round
to round, until it is next to nothing or no document fits; in the end one that is larger changes, if the pattern is
nearer to its words with it.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyweave.llm import common

MAX_REPEATS = 3
SEED = 20_011
#: Bits of the seeded hash in the first and the second histogram that find the end of a round.
FINE_BITS = 12
#: No more rounds for a pattern that misses no more than this share of the words that it gives.
NEAR = 0.0005
#: Larger documents that change, at most, once none fits.
SWAPS = 4
#: Plans of up to so many patterns are broadcast; more are joined by a shuffle. The driver holds a row for each pattern.
BROADCAST_PATTERNS = 100_000


def quotas(sizes: list[int], cap: int = MAX_REPEATS) -> list[float]:
    """Targets of sources in their order, weighing 1, 2, 3, 1, 2, 3, ...: shares of all words by weight, none above `cap`
    times its source's words, what is above shared anew among the others."""
    out = [0.0] * len(sizes)
    free, left = list(range(len(sizes))), float(sum(sizes))
    while free:
        weights = sum(k % 3 + 1 for k in free)
        over = {k for k in free if left * (k % 3 + 1) / weights > cap * sizes[k]}
        if not over:
            for k in free:
                out[k] = left * (k % 3 + 1) / weights
            return out
        for k in over:
            out[k] = float(cap * sizes[k])
        left -= sum(out[k] for k in sorted(over))
        free = [k for k in free if k not in over]
    return out


class Network:
    """Arcs with what room they have left; arc e ^ 1 goes back along arc e."""

    def __init__(self, n: int):
        self.arcs: list[list[int]] = [[] for _ in range(n)]
        self.to: list[int] = []
        self.room: list[int] = []

    def add(self, a: int, b: int, room: int) -> int:
        self.arcs[a].append(len(self.to))
        self.arcs[b].append(len(self.to) + 1)
        self.to += [b, a]
        self.room += [room, 0]
        return len(self.to) - 2

    def _levels(self, source: int, sink: int) -> list[int]:
        level = [-1] * len(self.arcs)
        level[source] = 0
        queue = deque([source])
        while queue and level[sink] < 0:
            a = queue.popleft()
            for e in self.arcs[a]:
                if self.room[e] and level[self.to[e]] < 0:
                    level[self.to[e]] = level[a] + 1
                    queue.append(self.to[e])
        return level

    def fill(self, source: int, sink: int) -> None:
        """Make the flow as large as can be: blocking flows along shortest paths, until the sink is out of reach."""
        to, room, arcs = self.to, self.room, self.arcs
        while (level := self._levels(source, sink))[sink] >= 0:
            tried = [0] * len(arcs)
            path: list[int] = []
            a = source
            while True:
                if a == sink:
                    amount = min(room[e] for e in path)
                    for e in path:
                        room[e] -= amount
                        room[e ^ 1] += amount
                    cut = next(i for i, e in enumerate(path) if not room[e])
                    a = to[path[cut] ^ 1]
                    del path[cut:]
                while tried[a] < len(arcs[a]) and not (room[e := arcs[a][tried[a]]] and level[to[e]] == level[a] + 1):
                    tried[a] += 1
                if tried[a] < len(arcs[a]):
                    path.append(arcs[a][tried[a]])
                    a = to[path[-1]]
                elif path:
                    a = to[path.pop() ^ 1]
                    tried[a] += 1
                else:
                    break


def route(patterns: list[tuple[tuple[int, ...], int]], quota: list[int], max_repeats: int = MAX_REPEATS) -> list[int]:
    """Words that each pattern (its sources, its words) gives in all, for whole-number quotas."""
    n, m = len(patterns), len(quota)
    net = Network(n + m + 2)
    given = [net.add(0, 1 + p, 0) for p in range(n)]
    for p, (own, size) in enumerate(patterns):
        for s in own:
            net.add(1 + p, 1 + n + s, max_repeats * size)
    for s, q in enumerate(quota):
        net.add(1 + n + s, 1 + n + m, q)
    for _ in range(max_repeats):
        for p, (_, size) in enumerate(patterns):
            net.room[given[p]] += size
        net.fill(0, 1 + n + m)
    return [net.room[e ^ 1] for e in given]


def _place(doc_id: Column, order: Column | int) -> Column:
    """2 * FINE_BITS bits of a seeded hash of a document, others for each order."""
    order = F.lit(order) if isinstance(order, int) else order
    return F.shiftrightunsigned(F.xxhash64(doc_id, order + SEED), 64 - 2 * FINE_BITS)


_PARTS = "parts array<struct<nth: int, high: long, least: long, most: long, take: boolean, one: boolean, id: long>>"
_EVERY = 1 << 2 * FINE_BITS


def _chosen(size: Column, doc_id: Column) -> Column:
    """Whether a document is taken beyond whole passes after all rounds; rows of one id and size go together."""

    def after(before: Column, x: Column) -> Column:
        meant = F.when(x["one"], x["id"].eqNullSafe(doc_id)).otherwise(_place(doc_id, x["nth"]) < x["high"])
        return F.when((size >= x["least"]) & (size <= x["most"]) & meant, x["take"]).otherwise(before)

    return (size > 0) & F.aggregate("parts", F.lit(False), after)


class Plan:
    """What a pattern gives: whole passes, and the rounds that choose documents for the words `gap` beyond them; below 0 they are too many."""

    def __init__(self, pattern: list[str | None], words: int, given: int):
        self.pattern, self.words, self.given = pattern, words, given
        self.passes, self.gap = divmod(given, words) if words else (0, 0)
        self.parts: list[tuple] = []

    def open(self) -> bool:
        return abs(self.gap) > NEAR * self.given

    def change(self, words: int, order: int, high: int, least: int, most: int) -> None:
        """Take, or give back, the documents of sizes least to most that lie below `high` in an order."""
        self.parts.append((order, high, least, most, self.gap > 0, False, None))
        self.gap -= words if self.gap > 0 else -words

    def change_one(self, words: int, doc_id: int | None, size: int) -> None:
        self.parts.append((0, 0, size, size, self.gap > 0, True, doc_id))
        self.gap -= words if self.gap > 0 else -words


def _beside(rows: DataFrame, few: DataFrame, n: int) -> DataFrame:
    return rows.join(F.broadcast(few) if n <= BROADCAST_PATTERNS else few, "pattern")


def _cuts(rows: DataFrame, n: int, *group: str) -> list:
    """For each group of rows (place, size, missing) of which not all can go: the place `at` at which `missing` is exceeded,
    the words `below` it and those `upto` its end.

    Two histograms narrow it down to 2^-24 of a group; both are sums by group and bin, so no task holds the documents of
    a pattern.
    """
    w = Window.partitionBy(*group).orderBy("bin")

    def crossing(sums: DataFrame) -> DataFrame:
        found = sums.withColumn("upto", F.col("before") + F.sum("size").over(w)).withColumn("below", F.col("upto") - F.col("size"))
        return found.where((F.col("upto") > F.col("missing")) & (F.col("below") <= F.col("missing"))).select(*group, F.col("bin").alias("at"), "below", "upto")

    coarse = rows.groupBy(*group, "missing", F.shiftright("place", FINE_BITS).alias("bin")).agg(F.sum("size").alias("size")).withColumn("before", F.lit(0))
    few = crossing(coarse).drop("upto")
    fine = rows.join(F.broadcast(few) if n <= BROADCAST_PATTERNS else few, list(group)).where(F.shiftright("place", FINE_BITS) == F.col("at"))
    return crossing(fine.groupBy(*group, "missing", F.col("below").alias("before"), F.col("place").alias("bin")).agg(F.sum("size").alias("size"))).collect()


def _by_class(rows: DataFrame, plans: list[Plan], by_pattern: dict[tuple, Plan]) -> None:
    """The first round: of each size class the share of its words that its pattern misses, to the nearest document."""
    if not plans:
        return
    bits = F.length(F.bin("size"))
    told = rows.sparkSession.createDataFrame([(p.pattern, p.gap / p.words) for p in plans], "pattern array<string>, share double")
    own = _beside(rows.where("size > 0"), told, len(plans)).select("pattern", "size", bits.alias("bits"), "share", _place(F.col("doc_id"), 0).alias("place"))
    sums = own.groupBy("pattern", "bits", "share").agg(F.sum("size").alias("all")).select("pattern", "bits", F.floor(F.col("share") * F.col("all")).alias("missing"))
    sums = common.checkpoint(sums)
    n = sums.count()
    classes = F.broadcast(sums) if n <= BROADCAST_PATTERNS else sums
    for r in _cuts(own.drop("share").join(classes, ["pattern", "bits"]).withColumnRenamed("missing", "wanted").withColumn("missing", F.col("wanted")), n, "pattern", "bits", "wanted"):
        nearer = r.upto - r.wanted < r.wanted - r.below
        if words := r.upto if nearer else r.below:
            plan = by_pattern[tuple(r.pattern)]
            plan.parts.append((0, r["at"] + nearer, 1 << r.bits - 1, (1 << r.bits) - 1, True, False, None))
            plan.gap -= words


def _open_to_change(rows: DataFrame, plans: list[Plan], order: int) -> DataFrame:
    """Documents not taken of patterns that miss words, taken ones of those that have too many, with their place in an order
    and how many words are missing or too many."""
    told = rows.sparkSession.createDataFrame([(p.pattern, p.gap, p.parts) for p in plans], f"pattern array<string>, gap long, {_PARTS}")
    left = _beside(rows, told, len(plans)).where((F.col("size") > 0) & ((F.col("gap") > 0) != _chosen(F.col("size"), F.col("doc_id"))))
    return left.select("pattern", F.abs("gap").alias("missing"), "doc_id", "size", _place(F.col("doc_id"), order).alias("place"))


def _change_alone(rows: DataFrame, picks: list[tuple[Plan, int | None, int]], most: float) -> set[int]:
    """Change each pick (plan, id, size) whose rows together have no more than `most` times the gap; which plans had one."""
    if not picks:
        return set()
    told = rows.sparkSession.createDataFrame([(k, p.pattern, i, s) for k, (p, i, s) in enumerate(picks)], "k int, pattern array<string>, id long, its long")
    found = _beside(rows, told, len(picks)).where(F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("size") == F.col("its")))
    changed = set()
    for r in found.groupBy("k").agg(F.sum("size").alias("all")).collect():
        plan, doc_id, size = picks[r.k]
        if r["all"] <= most * abs(plan.gap):
            plan.change_one(r["all"], doc_id, size)
            changed.add(id(plan))
    return changed


def _mend(rows: DataFrame, going: list[Plan], by_pattern: dict[tuple, Plan], orders: Iterator[int]) -> None:
    """Rounds that halve what the plans miss or have too many, until it is next to nothing or no document fits."""
    while going:
        order = next(orders)
        fit = _open_to_change(rows, going, order).where("size <= missing")
        large = F.when(2 * F.col("size") >= F.col("missing"), F.struct("place", "doc_id", "size"))
        picks, cut = [], []
        for r in fit.groupBy("pattern").agg(F.sum("size").alias("all"), F.min(large).alias("one")).collect():
            plan = by_pattern[tuple(r.pattern)]
            if r["all"] <= abs(plan.gap):
                plan.change(r["all"], order, _EVERY, 1, abs(plan.gap))
            elif r.one:
                picks.append((plan, r.one.doc_id, r.one.size))
            else:
                cut.append(plan)
        changed = _change_alone(rows, picks, 1.0)
        cut += [p for p, *_ in picks if id(p) not in changed]
        going = [p for p, *_ in picks if id(p) in changed and p.open()]
        if cut:
            names = rows.sparkSession.createDataFrame([(p.pattern,) for p in cut], "pattern array<string>")
            for r in _cuts(_beside(fit, names, len(cut)), len(cut), "pattern"):
                plan = by_pattern[tuple(r.pattern)]
                if r.below:
                    plan.change(r.below, order, r["at"], 1, abs(plan.gap))
                    if plan.open():
                        going.append(plan)


def choose(rows: DataFrame, plans: list[Plan]) -> None:
    """Fill what the plans miss from rows (pattern, doc_id, size). What reaches the driver is a row for each pattern or each of
    its size classes.

    Where no document fits any more, a larger one changes and its excess is mended in turn, up to SWAPS times; the nearest
    of all the states that a pattern went through holds.
    """
    by_pattern = {tuple(p.pattern): p for p in plans}
    orders = count(1)
    _by_class(rows, [p for p in plans if p.gap], by_pattern)
    _mend(rows, [p for p in plans if p.open()], by_pattern, orders)
    best = {id(p): (abs(p.gap), p.gap, list(p.parts)) for p in plans}
    for _ in range(SWAPS):
        going = [p for p in plans if best[id(p)][0] > NEAR * p.given]
        if not going:
            break
        larger = _open_to_change(rows, going, next(orders)).where("size > missing")
        nearest = larger.groupBy("pattern").agg(F.min(F.struct((F.col("size") >= 2 * F.col("missing")).alias("far"), "place", "doc_id", "size")).alias("one")).collect()
        changed = _change_alone(rows, [(by_pattern[tuple(r.pattern)], r.one.doc_id, r.one.size) for r in nearest], float("inf"))
        _mend(rows, [p for p in going if id(p) in changed and p.open()], by_pattern, orders)
        for p in going:
            best[id(p)] = min(best[id(p)], (abs(p.gap), p.gap, list(p.parts)), key=lambda x: x[0])
    for p in plans:
        _, p.gap, p.parts = best[id(p)]


def _overlapping(sizes: list[int], total: int) -> list[float]:
    """Sources that share documents: quotas as before, but together no more than all words."""
    goal = quotas(sizes)
    return [g * total / (sum(goal) or 1.0) for g in goal]


def settle(rows: DataFrame) -> tuple[list[Plan], list[dict]]:
    """The plans of all patterns of rows (doc_id, size, pattern array<string>), and of each source its size and target."""
    found = [(tuple(r.pattern), r.words) for r in rows.groupBy("pattern").agg(F.sum("size").alias("words")).collect()]
    names = sorted({s for p, _ in found for s in p}, key=lambda s: (s is None, s or ""))
    number = {s: k for k, s in enumerate(names)}
    found.sort(key=lambda x: [number[s] for s in x[0]])
    sizes = [0] * len(names)
    for p, words in found:
        for s in set(p):
            sizes[number[s]] += words
    total = sum(words for _, words in found)
    goal = quotas(sizes) if sum(sizes) == total else _overlapping(sizes, total)
    given = route([(tuple(sorted({number[s] for s in p})), words) for p, words in found], [round(q) for q in goal])
    plans = [Plan(list(p), words, g) for (p, words), g in zip(found, given, strict=True)]
    choose(rows, plans)
    return plans, [{"source": s, "source_size": sizes[k], "target": goal[k]} for s, k in number.items()]


def _pattern(source_col: str, member_col: str | None) -> Column:
    """The sorted set of sources that may claim a document: its one source, or those of an array column; none at all counts as a null source."""
    if member_col is None:
        return F.array(F.col(f"`{source_col}`").cast("string"))
    members = F.array_sort(F.array_distinct(F.col(f"`{member_col}`").cast("array<string>")))
    return F.when(F.size(members) > 0, members).otherwise(F.array(F.lit(None).cast("string")))


def _narrow(docs: DataFrame, id_col: str, text_col: str, source_col: str, member_col: str | None = None) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), _pattern(source_col, member_col).alias("pattern"), common.n_words(F.col(f"`{text_col}`")).alias("size"))


def _times(size: Column, doc_id: Column) -> Column:
    """How often a document is taken, given its pattern's plan."""
    return F.col("passes") + F.when(_chosen(size, doc_id), 1).otherwise(0)


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", member_col: str | None = None) -> DataFrame:
    """doc_id, size, source_size, target and taken of each row, its pattern being its one source; with member_col, an array
    of all sources that may claim a document, doc_id, size, sources and taken.

    A null text has size 0 and gives no word; a null source is the last source. Rows of one id and size are taken alike. An
    empty table gives an empty result. Of a text, however long, only its words are counted, and it is taken whole.
    """
    spark = docs.sparkSession
    rows = common.checkpoint(_narrow(docs, id_col, text_col, source_col, member_col))
    plans, about = settle(rows)
    own = {a["source"]: a for a in about}
    told = [(p.pattern, p.passes, p.parts, *((own[p.pattern[0]]["source_size"], own[p.pattern[0]]["target"]) if member_col is None else (None, None))) for p in plans]
    settled = spark.createDataFrame(told, f"pattern array<string>, passes long, {_PARTS}, source_size long, target double")
    taken = F.col("size") * _times(F.col("size"), F.col("doc_id"))
    columns = ("source_size", "target") if member_col is None else (F.col("pattern").alias("sources"),)
    return _beside(rows, settled, len(told)).select("doc_id", "size", *columns, taken.alias("taken"))


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", member_col: str | None = None) -> DataFrame:
    """The rows of `docs` as often as the mix takes them, columns as they are."""
    plans, _ = settle(common.checkpoint(_narrow(docs, id_col, text_col, source_col, member_col)))
    settled = docs.sparkSession.createDataFrame([(p.pattern, p.passes, p.parts) for p in plans], f"pattern array<string>, passes long, {_PARTS}")
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), _pattern(source_col, member_col).alias("pattern"), common.n_words(F.col(f"`{text_col}`")).alias("size"))
    times = _beside(whole, settled, len(plans)).select("row", _times(F.col("size"), F.col("doc_id")).alias("times")).where("times > 0")
    return times.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).select("row.*")


def settled_plan(spark: SparkSession, docs: DataFrame) -> list[dict]:
    """Sources, their sizes and their targets."""
    return settle(_narrow(docs, "doc_id", "text", "source"))[1]
