"""Language identification by compression: the language whose dictionary makes a text smallest.

For each language a raw-content dictionary for zstandard is laid together from whole labelled texts. Of a text, its
letters and their marks count, in lower case, with single spaces for all else. It is cut into blocks, so that the
dictionary counts in all of it and not only at its beginning; each block is compressed with each dictionary, and a text
goes to the language with the least sum. Where the second language needs little more, the text is rejected.

zstandard stores a text of a few words as it is, whatever the dictionary. So a short text with a narrow margin is measured
once more, by the bytes that it adds to each of some carriers, strings that no language favours, at the highest level.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.llm import common

UNKNOWN = "und"
#: The bounded sample that dictionaries are made from: documents for each language, whole. Those of more bytes than
#: LONG_BYTES are the last to be taken, so that a few of them don't fill the dictionary.
SAMPLE_DOCS, LONG_BYTES = 200, 1 << 16
#: Compressors that a worker holds at once; with more languages they are made anew for each slice of texts.
HELD = 64
BLOCK_BYTES, LEVEL = 2048, 3
#: A text is rejected where the best language saves no more than this share of the second's size.
NARROW = 0.02
#: Texts of up to so many bytes are measured behind carriers where the margin is narrow; and what is narrow there.
SHORT_BYTES, CARRIERS, CARRIER_WORDS, FINE_LEVEL, NARROW_BEHIND = 256, 16, 48, 19, 0.05
_OTHER = regex.compile(r"[^\p{L}\p{M}]+")
_LETTER = regex.compile(r"\p{L}")


def letters(text: str | None) -> bytes:
    """The words of a text in lower case, one space around each; empty where it has no letter."""
    if not text or not _LETTER.search(text):
        return b""
    return f" {_OTHER.sub(' ', text.lower()).strip()} ".encode()


def fold(doc_id: Column, of: int) -> Column:
    """crc32 of the id as text, modulo `of`."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(of))


def labelled_sample(docs: DataFrame, training: Column, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id") -> dict[str, bytes]:
    """A dictionary for each language, from SAMPLE_DOCS whole documents in the order of a hash of their text.

    Spark keeps so many rows of a language in each task before it deals them by language. What reaches the driver is
    SAMPLE_DOCS rows for each language.
    """
    text, key = F.col(f"`{text_col}`").cast("string"), F.xxhash64(F.col(f"`{text_col}`").cast("string"), F.lit(5))
    rows = docs.where(training & F.col(f"`{lang_col}`").isNotNull() & text.isNotNull() & text.rlike(r"\p{L}"))
    rows = rows.select(F.col(f"`{lang_col}`").cast("string").alias("lang"), (F.octet_length(text) > LONG_BYTES).alias("long"), key.alias("key"), text.alias("text"))
    by_lang = Window.partitionBy("lang").orderBy("long", "key", "text")
    few = rows.withColumn("nth", F.row_number().over(by_lang)).where(F.col("nth") <= SAMPLE_DOCS)
    found: dict[str, list[tuple[int, bytes]]] = {}
    for r in few.select("lang", "nth", "text").toLocalIterator():
        found.setdefault(r.lang, []).append((r.nth, letters(r.text)))
    return {lang: b"".join(t for _, t in sorted(texts)) for lang, texts in sorted(found.items())}


def carriers(dictionaries: dict[str, bytes]) -> list[bytes]:
    """Strings of words of all languages in turn, each word backwards, so that they are long enough to be compressed and no
    language has them."""
    rng, words = random.Random(5), [w for d in dictionaries.values() if (w := d.split())]
    if not words:
        return []
    pick = lambda k: rng.choice(words[k % len(words)]).decode()[::-1]
    return [f" {' '.join(pick(k) for k in range(CARRIER_WORDS))} ".encode() for _ in range(CARRIERS)]


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes]):
        self.languages, self.dictionaries = list(dictionaries), list(dictionaries.values())
        self.carriers = carriers(dictionaries)
        self.presses: dict[tuple[int, int], zstandard.ZstdCompressor] = {}

    def press(self, k: int, level: int) -> zstandard.ZstdCompressor:
        if (k, level) not in self.presses:
            if len(self.presses) >= HELD:
                self.presses.clear()
            raw = zstandard.ZstdCompressionDict(self.dictionaries[k], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            raw.precompute_compress(level=level)
            self.presses[k, level] = zstandard.ZstdCompressor(dict_data=raw, write_content_size=False, write_checksum=False, write_dict_id=False)
        return self.presses[k, level]

    def sizes(self, texts: list[bytes]) -> np.ndarray:
        """Compressed bytes of each text, by row, with each language's dictionary."""
        out = np.zeros((len(texts), len(self.languages)))
        for k in range(len(self.languages)):
            compress = self.press(k, LEVEL).compress
            out[:, k] = [sum(len(compress(t[i : i + BLOCK_BYTES])) for i in range(0, len(t), BLOCK_BYTES)) for t in texts]
        return out

    def sizes_behind(self, texts: list[bytes]) -> np.ndarray:
        """Bytes that each text adds to a carrier, in the mean."""
        out = np.zeros((len(texts), len(self.languages)))
        for k in range(len(self.languages)):
            compress = self.press(k, FINE_LEVEL).compress
            alone = sum(len(compress(c)) for c in self.carriers)
            out[:, k] = [(sum(len(compress(c + t[1:])) for c in self.carriers) - alone) / CARRIERS for t in texts]
        return out

    def classify(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """Of each text language, score from 0 to 1 and whether the margin is wide enough.

        The score is the best language's share when languages weigh 2 to the bits they save; ties go to the first
        language by name. With one language there is no margin and nothing to reject; with none, a text with a letter
        is `und` and not rejected, as nothing is known against it.
        """
        plain = [letters(t) for t in texts]
        out: list[tuple[str, float, bool]] = [(UNKNOWN, 0.0, bool(p) and not self.languages) for p in plain]
        own = [k for k, p in enumerate(plain) if p]
        if not own or not self.languages:
            return out
        sizes = self.sizes([plain[k] for k in own])
        sure = _margin(sizes) > NARROW
        again = [i for i, k in enumerate(own) if not sure[i] and len(plain[k]) <= SHORT_BYTES]
        if again:
            sizes[again] = self.sizes_behind([plain[own[i]] for i in again])
            sure[again] = _margin(sizes[again]) > NARROW_BEHIND
        best = sizes.argmin(axis=1)
        bits = np.clip(8 * (sizes - sizes.min(axis=1, keepdims=True)), 0, 60)
        scores = 1 / np.exp2(-bits).sum(axis=1)
        for i, k in enumerate(own):
            out[k] = (self.languages[best[i]], float(scores[i]), bool(sure[i]))
        return out


def _margin(sizes: np.ndarray) -> np.ndarray:
    """What the best language saves as a share of the second's size."""
    if sizes.shape[1] < 2:
        return np.ones(len(sizes))
    two = np.sort(sizes, axis=1)[:, :2]
    return (two[:, 1] - two[:, 0]) / np.maximum(two[:, 1], 1e-9)


SCHEMA = "doc_id long, lang_pred string, score double, accepted boolean"


def _texts(sent, key: str, column: pa.Array) -> Iterator[tuple[int, list[tuple[str, float, bool]]]]:
    own = common.held(key, lambda: Classifier(sent.value))
    _, at = common.utf8(column)
    for low, high in common.slices(at):
        yield low, own.classify(column.slice(low, high - low).to_pylist())


def _key(dictionaries: dict[str, bytes]) -> str:
    return f"langid {zlib.crc32(repr(list(dictionaries)).encode())} {[zlib.crc32(d) for d in dictionaries.values()]}"


def predict(docs: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score and accepted of each row, without a shuffle.

    A text that is null or has no letter is `und`, with score 0, and isn't accepted. Ids may be null or repeated, and each
    row gets its own result; equal texts get the same. A long text is compressed block by block.
    """
    sent, key = docs.sparkSession.sparkContext.broadcast(dictionaries), _key(dictionaries)

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, found in _texts(sent, key, batch.column(1)):
                langs, scores, ok = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, len(found)), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(ok, pa.bool_())], names=["doc_id", "lang_pred", "score", "accepted"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(common.released(predicted), SCHEMA)


def accepted_rows(docs: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text") -> DataFrame:
    """The rows of `docs` whose language is recognised, columns as they are; without any dictionary, those with a letter."""
    sent, key, place = docs.sparkSession.sparkContext.broadcast(dictionaries), _key(dictionaries), docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, found in _texts(sent, key, batch.column(place)):
                kept = batch.slice(low, len(found)).filter(pa.array([ok for _, _, ok in found], pa.bool_()))
                if len(kept):
                    yield kept

    return docs.mapInArrow(common.released(keep), docs.schema)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(fold(doc_id, 5) == 0, F.lit(False))


def languages_of(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score and accepted, learned from the rows that aren't held out; a null id is not held out."""
    out = predict(docs, labelled_sample(docs, ~held_out(F.col("doc_id"))))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "accepted")
