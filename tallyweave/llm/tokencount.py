"""Token counts by byte-pair merging with a heap and a linked list; no ids are made.

The symbols of a piece of text are its characters. The adjacent pair whose joined string has the lowest rank in the
vocabulary is merged, the leftmost first among equals, until no adjacent pair is in the vocabulary. The count is the
number of symbols at first less the number of merges; a character that the vocabulary lacks counts its UTF-8 bytes.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm import common

SPACE = "▁"
#: Distinct pieces of text that a worker remembers, twice at most, and the most characters of each; longer ones, as in
#: texts without spaces, are forgotten after the batch that they stand in.
CACHE_UNITS, CACHE_CHARS = 600_000, 64


def count_merged(symbols: str, rank: dict[str, int]) -> int:
    """Symbols that remain of a string, before bytes of unknown characters are counted."""
    n = len(symbols)
    if n < 2:
        return n
    piece = list(symbols)
    heap = [(r, i, a + b) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if (r := rank.get(a + b)) is not None]
    if not heap:
        return n
    heapify(heap)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    left = n
    while heap:
        _, i, joined = heappop(heap)
        own = piece[i]
        if own is None or (j := after[i]) == n or own + piece[j] != joined:
            continue  # one of the two has been merged since
        piece[i], piece[j] = joined, None
        left -= 1
        k = after[i] = after[j]
        if k != n:
            before[k] = i
            if (r := rank.get(pair := joined + piece[k])) is not None:
                heappush(heap, (r, i, pair))
        h = before[i]
        if h >= 0 and (r := rank.get(pair := piece[h] + joined)) is not None:
            heappush(heap, (r, h, pair))
    return left


class Counter:
    """Token counts of whole texts for one vocabulary file of the sentencepiece library.

    No piece of the vocabulary holds a space mark after another character, so merges stay within the stretches of text
    before such spaces; and merges never cross two characters that stand side by side in no piece. Both kinds of cut give
    short strings that repeat, whose counts are remembered.
    """

    def __init__(self, model: bytes):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [(library.id_to_piece(i), library.get_score(i)) for i in range(library.get_piece_size()) if not (library.is_control(i) or library.is_unknown(i) or library.is_byte(i) or library.is_unused(i))]
        if any(SPACE in p.lstrip(SPACE) for p, _ in pieces):
            raise ValueError("a piece crosses a space")
        order = {s: r for r, s in enumerate(sorted({s for _, s in pieces}, reverse=True))}
        self.rank = {p: order[s] for p, s in pieces}  # equal scores share a rank: the leftmost pair goes first
        self.pairs = {p[i : i + 2] for p in self.rank for i in range(len(p) - 1)}
        self.known: dict[str, int] = {}
        self.older: dict[str, int] = {}
        self.parts: dict[str, int] = {}

    def part(self, s: str) -> int:
        if (n := self.parts.get(s)) is None:
            n = count_merged(s, self.rank)
            for c in s:
                if c not in self.rank:
                    n += len(c.encode()) - 1
            if len(s) > CACHE_CHARS:
                return n
            if len(self.parts) > CACHE_UNITS:
                self.parts = {}
            self.parts[s] = n
        return n

    def unit(self, s: str) -> int:
        """The count of a stretch that begins with its space mark."""
        total = low = 0
        pairs = self.pairs
        for i in range(1, len(s)):
            if s[i - 1 : i + 1] not in pairs:
                total += self.part(s[low:i])
                low = i
        return total + self.part(s[low:])

    _cuts = re.compile("(?<=[^ ])(?= )")

    def count(self, texts: list[str]) -> list[int]:
        if len(self.known) > CACHE_UNITS:
            self.older, self.known = self.known, {}
        known, cut, long = self.known, [], []
        wanted: set[str] = set()
        for text in texts:
            if SPACE in text:
                text = text.replace(SPACE, " ")
            if "  " in text or text.startswith(" ") or text.endswith(" "):
                units = [u[1:] for u in self._cuts.split(" " + text)] if text else []
            else:
                units = text.split(" ") if text else []
            cut.append(units)
            wanted.update(units)
        for u in wanted:
            if u not in known:
                old = self.older.get(u)
                known[u] = old if old is not None else self.unit(SPACE + u.replace(" ", SPACE))
                if len(u) > CACHE_CHARS:
                    long.append(u)
        out = [sum(map(known.__getitem__, units)) for units in cut]
        for u in long:
            del known[u]
        return out


def counter(model: bytes) -> Counter:
    """One counter for each vocabulary and Python worker."""
    return common.held(f"tokencount {zlib.crc32(model)}", lambda: Counter(model))


SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def count_tokens(docs: DataFrame, model: bytes, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of each row, without a shuffle.

    A null text counts as empty: 0 bytes and 0 tokens. Ids may be null or repeated; each row gets its own result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(sent.value)
        for batch in batches:
            _, at = common.utf8(batch.column(1))
            for low, high in common.slices(at):
                part = batch.slice(low, high - low)
                n = np.array(own.count([t or "" for t in part.column(1).to_pylist()]), np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(at[low : high + 1])), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(common.released(counted), SCHEMA)
