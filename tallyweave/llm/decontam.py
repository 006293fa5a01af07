"""Benchmark decontamination: a broadcast hash set of the items' word windows, looked up at every window of the documents.

Words are maximal runs of letters a-z (A-Z lower-cased), digits and characters beyond ASCII. An item's windows are its
runs of `width` words; an item of fewer words, but not none, is one window. A hit is verified word by word.

A benchmark of more than BROADCAST_BYTES isn't sent whole. Its windows are then rows, and what is broadcast is a bitmap
of their hashes, of a bounded size. Windows of the documents that the bitmap lets through, few in clean text, are joined
to the benchmark's on their words.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.llm import common

WIDTH = 10
#: Most bytes of benchmark text that are broadcast as windows; a larger benchmark goes by bitmap and join.
BROADCAST_BYTES = 8 << 20
#: Bits of the bitmap for each window, and the least and most of all of them as powers of two: 128 MB at most.
BITS_A_WINDOW, LEAST_BITS, MOST_BITS = 16, 20, 30
#: Contaminated texts up to so many are dropped by a broadcast of their hashes, more by a shuffle.
BROADCAST_TEXTS = 500_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[48:58] = _IN_WORD[97:123] = _IN_WORD[128:] = True

def words_of(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, and the starts and ends of words in them."""
    lower = _LOWER[raw]
    return lower, *common.runs(_IN_WORD[lower])


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of `width` word hashes."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = (out * np.uint64(0x9E3779B97F4A7C15)) ^ words[k : k + n]
        out *= np.uint64(0xD6E8FEB86659FD93)
    return common.mix64(out)


class Words:
    """The words of texts raw[at[i]:at[i+1]]: bytes in lower case, starts, ends and hashes of words, and where each text's words begin."""

    def __init__(self, raw: np.ndarray, at: np.ndarray):
        self.base, self.n = int(at[0]), len(at) - 1
        # a byte that is in no word stands between texts, so no word spans two of them
        room = np.zeros(int(at[-1]) - self.base + self.n, np.uint8)
        inside = np.ones(len(room), bool)
        inside[at[1:] - self.base + np.arange(self.n)] = False
        room[inside] = raw[self.base : int(at[-1])]
        self.lower, self.starts, self.ends = words_of(room)
        self.hashes = common.word_hashes(self.lower, self.starts, self.ends)
        self.first = at[:-1] - self.base + np.arange(self.n)
        self.border = np.searchsorted(self.starts, at - self.base + np.arange(self.n + 1))
        self.text_of = np.repeat(np.arange(self.n), np.diff(self.border))
        self._data: bytes | None = None

    def joined(self, i: int, width: int) -> bytes:
        """The words of the window that begins with word i, a space between two."""
        if self._data is None:
            self._data = self.lower.tobytes()
        return b" ".join(self._data[a:b] for a, b in zip(self.starts[i : i + width].tolist(), self.ends[i : i + width].tolist(), strict=True))

    def within(self, where: np.ndarray, width: int) -> np.ndarray:
        """The windows at `where` that lie in one text."""
        return where[self.text_of[where] == self.text_of[where + width - 1]]


def _item_windows(text: str, width: int) -> Iterator[tuple[int, int, bytes]]:
    """Width, hash and words of each window of an item."""
    raw = np.frombuffer(text.encode(), np.uint8)
    words = Words(raw, np.array([0, len(raw)]))
    own = min(width, len(words.hashes))
    if own:
        for i, h in enumerate(window_hashes(words.hashes, own).tolist()):
            yield own, h, words.joined(i, own)


class Windows:
    """The windows of a set of items: for each width the sorted hashes, and by hash the words and the items."""

    def __init__(self, items: list[tuple[str, str]], width: int = WIDTH):
        self.width, self.by_width = width, {}
        found: dict[int, dict[int, dict[bytes, set[str]]]] = {}
        for item, text in items:
            for own, h, joined in _item_windows(text, width):
                found.setdefault(own, {}).setdefault(h, {}).setdefault(joined, set()).add(item)
        for own, by_hash in found.items():
            hashes = np.array(sorted(by_hash), np.uint64)
            # a bit for each value of the hash's low 20 bits: most windows of clean text end there
            seen = np.zeros(1 << 20, bool)
            seen[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
            self.by_width[own] = (hashes, seen, by_hash)

    def hits(self, raw: np.ndarray, at: np.ndarray) -> list[tuple[int, np.ndarray, set[str], list[tuple[int, int]]]]:
        """For each text raw[at[i]:at[i+1]]: its word count, a mask of hit words, the items, the hit spans in bytes."""
        words = Words(raw, at)
        covered = np.zeros(len(words.hashes) + 1, np.int64)
        items: dict[int, set[str]] = {}
        for own, (hashes, seen, by_hash) in self.by_width.items():
            wanted = window_hashes(words.hashes, own)
            where = np.flatnonzero(seen[(wanted & np.uint64((1 << 20) - 1)).astype(np.int64)])
            if not len(where):
                continue
            place = np.minimum(np.searchsorted(hashes, wanted[where]), len(hashes) - 1)
            for i in words.within(where[hashes[place] == wanted[where]], own).tolist():
                if real := by_hash[int(wanted[i])].get(words.joined(i, own)):
                    covered[i] += 1
                    covered[i + own] -= 1
                    items.setdefault(int(words.text_of[i]), set()).update(real)
        hit = np.cumsum(covered[:-1]) > 0
        out = []
        for k in range(words.n):
            low, high = words.border[k], words.border[k + 1]
            mask, spans = hit[low:high], []
            if k in items:
                first = int(words.first[k])
                for a, b in zip(*common.runs(mask), strict=True):
                    spans.append((int(words.starts[low + a]) - first, int(words.ends[low + b - 1]) - first))
            out.append((int(high - low), mask, items.get(k, set()), spans))
        return out


def _items(benchmark: DataFrame, item_col: str, text_col: str) -> tuple[DataFrame, bool]:
    """item and text of the items that have a text, and whether they are few enough to broadcast."""
    items = benchmark.select(F.coalesce(F.col(f"`{item_col}`").cast("string"), F.lit("")).alias("item"), F.col(f"`{text_col}`").cast("string").alias("text")).where("text is not null")
    return items, (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) <= BROADCAST_BYTES


_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
_FOUND = "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>"


def _known(sent, key: str, width: int) -> Windows:
    return common.held(f"decontam {key}", lambda: Windows(sent.value, width))


def _looked_up(sent, key: str, width: int):
    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = common.utf8(batch.column(1))
            for low, high in common.slices(at):
                found = _known(sent, key, width).hits(raw, at[low : high + 1])
                columns = [
                    batch.column(0).slice(low, high - low),
                    pa.array([x[0] for x in found], pa.int64()),
                    pa.array([int(x[1].sum()) for x in found], pa.int64()),
                    pa.array([sorted(x[2]) for x in found], pa.list_(pa.string())),
                    pa.array([[{"start": a, "end": b} for a, b in x[3]] for x in found], pa.list_(_SPAN)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_hit", "items", "spans"])

    return common.released(scanned)


_WINDOW = "width int, hash long, words string, item string"


def _windowed(width: int):
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = {(own, h, w) for own, h, w in _item_windows(text, width)}
                if rows:
                    widths, hashes, words = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(widths, pa.int32()), pa.array(np.array(hashes, np.uint64).view(np.int64)), pa.array(words, pa.binary()).cast(pa.string()), pa.array([item] * len(rows), pa.string())], names=["width", "hash", "words", "item"])

    return made


def _bitmap(windows: DataFrame) -> tuple[np.ndarray, int]:
    """A bit for each value of the low bits of the windows' hashes, in bytes; and how many bits of a hash that is.

    Executors set the bits; what reaches the driver is the bitmap, whose size is bounded.
    """
    n = windows.count()
    bits = min(MOST_BITS, max(LEAST_BITS, (BITS_A_WINDOW * n).bit_length()))
    slot = F.col("hash").bitwiseAND(F.lit((1 << bits) - 1))
    pieces = windows.groupBy(F.shiftright(slot, 15).alias("piece")).agg(F.bitmap_construct_agg(slot.bitwiseAND(F.lit((1 << 15) - 1))).alias("bitmap"))
    out = np.zeros(1 << bits - 3, np.uint8)
    for r in pieces.toLocalIterator():
        out[r.piece << 12 : (r.piece + 1) << 12] = np.frombuffer(r.bitmap, np.uint8)
    return out, bits


_CANDIDATES = "rid long, doc_id long, h long, other long, n_words long, found array<struct<i:int,width:int,words:string,start:long,end:long>>"
_CANDIDATE = pa.struct([("i", pa.int32()), ("width", pa.int32()), ("words", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def _let_through(sent, bits: int, widths: list[int]):
    """The windows of each text whose bit is set."""

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, low_bits = sent.value, np.uint64((1 << bits) - 1)
        for batch in batches:
            raw, at = common.utf8(batch.column("text"))
            for low, high in common.slices(at):
                words = Words(raw, at[low : high + 1])
                found: list[list[dict]] = [[] for _ in range(words.n)]
                for width in widths:
                    slot = (window_hashes(words.hashes, width) & low_bits).astype(np.int64)
                    where = np.flatnonzero(bitmap[slot >> 3] >> (slot & 7).astype(np.uint8) & 1)
                    for i in words.within(where, width).tolist():
                        k = int(words.text_of[i])
                        first = int(words.first[k])
                        found[k].append({"i": i - int(words.border[k]), "width": width, "words": words.joined(i, width).decode(), "start": int(words.starts[i]) - first, "end": int(words.ends[i + width - 1]) - first})
                columns = [batch.column(c).slice(low, high - low) for c in ("rid", "doc_id", "h", "other")]
                columns += [pa.array(np.diff(words.border).astype(np.int64)), pa.array(found, pa.list_(_CANDIDATE))]
                yield pa.RecordBatch.from_arrays(columns, names=["rid", "doc_id", "h", "other", "n_words", "found"])

    return common.released(scanned)


def _joined(rows: DataFrame, items: DataFrame, width: int) -> DataFrame:
    """doc_id, h, other, n_words, n_hit, items and spans of rows (doc_id, text, h, other), by bitmap and join."""
    spark = rows.sparkSession
    windows = common.checkpoint(items.mapInArrow(_windowed(width), _WINDOW).distinct())
    widths = sorted(r.width for r in windows.select("width").distinct().collect())
    bitmap, bits = _bitmap(windows)
    sent = spark.sparkContext.broadcast(bitmap)
    numbered = rows.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text", "h", "other")
    looked = common.checkpoint(numbered.mapInArrow(_let_through(sent, bits, widths), _CANDIDATES))
    candidates = looked.select("rid", F.explode("found").alias("c")).select("rid", "c.*")
    hits = candidates.join(windows.select("width", "words", "item"), ["width", "words"])
    place = F.struct("i", (F.col("i") + F.col("width")).alias("to"), "start", "end")
    of_row = hits.groupBy("rid").agg(F.sort_array(F.collect_set(place)).alias("at"), F.sort_array(F.collect_set("item")).alias("items"))
    run = "struct<to:int,start:bigint,end:bigint>"
    begin = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast(run).alias("open"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("closed"))

    def sweep(state: Column, x: Column) -> Column:
        """Words that a further window adds; windows that touch or overlap are one run."""
        open_ = state["open"]
        goes_on = F.coalesce(x["i"] <= open_["to"], F.lit(False))
        added = x["to"] - F.when(goes_on, F.least(x["to"], open_["to"])).otherwise(x["i"])
        further = F.when(goes_on & (open_["to"] >= x["to"]), open_).when(goes_on, F.struct(x["to"].alias("to"), open_["start"].alias("start"), x["end"].alias("end"))).otherwise(F.struct(x["to"].alias("to"), x["start"].alias("start"), x["end"].alias("end")))
        ended = F.when(goes_on | open_.isNull(), state["closed"]).otherwise(F.concat(state["closed"], F.array(F.struct(open_["start"].alias("start"), open_["end"].alias("end")))))
        return F.struct((state["n"] + added).alias("n"), further.cast(run).alias("open"), ended.alias("closed"))

    whole = lambda state: F.struct(state["n"].alias("n"), F.concat(state["closed"], F.array(F.struct(state["open"]["start"].alias("start"), state["open"]["end"].alias("end")))).alias("spans"))
    swept = of_row.select("rid", "items", F.aggregate("at", begin, sweep, whole).alias("s"))
    out = looked.drop("found").join(swept, "rid", "left")
    none = lambda kind: F.array().cast(kind)
    return out.select("doc_id", "h", "other", "n_words", F.coalesce("s.n", F.lit(0)).alias("n_hit"), F.coalesce("items", none("array<string>")).alias("items"), F.coalesce("s.spans", none("array<struct<start:bigint,end:bigint>>")).alias("spans"))


def _text_hashes(text: Column) -> tuple[Column, Column]:
    """Two hashes that tell a text from any other."""
    return F.xxhash64(text), F.xxhash64(text, F.lit(1))


def scan(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", spans: bool = False) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of each row; spans adds the items and the hit byte spans.

    A null text has no words; an item without text has no window, one with a null id goes by the empty string. Repeated
    rows get a result each; an empty benchmark hits nothing. The documents' texts are never shuffled, and a long one is
    looked up in a slice of its own.
    """
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"))
    items, few = _items(benchmark, item_col, "text")
    if few:
        sent = docs.sparkSession.sparkContext.broadcast([(r.item, r.text) for r in items.collect()])
        found = rows.mapInArrow(_looked_up(sent, uuid.uuid4().hex, width), _FOUND)
    else:
        h, other = _text_hashes(F.col("text"))
        found = _joined(rows.withColumns({"h": h, "other": other}), items, width)
    out = found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), *(["items", "spans"] if spans else []))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, text_col: str = "text") -> DataFrame:
    """The rows of `docs` without any hit, columns as they are; a null text has none."""
    items, few = _items(benchmark, "item_id", "text")
    if few:
        sent = docs.sparkSession.sparkContext.broadcast([(r.item, r.text) for r in items.collect()])
        return docs.mapInArrow(_keeper(sent, uuid.uuid4().hex, width, docs.columns.index(text_col)), docs.schema)
    text = F.col(f"`{text_col}`").cast("string")
    h, other = _text_hashes(text)
    rows = docs.select(F.lit(None).cast("long").alias("doc_id"), text.alias("text"), h.alias("h"), other.alias("other"))
    gone = common.checkpoint(_joined(rows, items, width).where("n_hit > 0").select(F.col("h").alias("__h"), F.col("other").alias("__other")).distinct())
    known = F.broadcast(gone) if gone.limit(BROADCAST_TEXTS + 1).count() <= BROADCAST_TEXTS else gone
    return docs.join(known, (h == F.col("__h")) & (other == F.col("__other")), "left_anti")


def _keeper(sent, key: str, width: int, place: int):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = common.utf8(batch.column(place))
            for low, high in common.slices(at):
                ok = [not x[2] for x in _known(sent, key, width).hits(raw, at[low : high + 1])]
                kept = batch.slice(low, high - low).filter(pa.array(ok, pa.bool_()))
                if len(kept):
                    yield kept

    return common.released(keep)
