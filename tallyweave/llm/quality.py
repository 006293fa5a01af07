"""Quality scores by supervised subword embeddings.

The features of a text are its words, its pairs of neighbouring words, and the character 3- to 5-grams within a word and
its borders, hashed into buckets. Each bucket has a learned vector; a text is the average of its features' vectors, and a
softmax layer gives the probabilities of the labels. Training is stochastic gradient descent in numpy on a bounded
sample of labelled rows. As averaging and the layer before the softmax are linear, scoring looks up one number for each
feature, the bucket's vector times the difference of the two labels' weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.llm import common
from tallyweave.llm.langid import fold

BUCKETS, DIM = 1 << 17, 12
GRAMS = (3, 4, 5)
#: The bounded sample for training: labelled rows, each with its whole text.
SAMPLE_ROWS = 3000
EPOCHS, RATE, SEED = 5, 0.6, 7
THRESHOLD = 0.7

_SPACES = np.zeros(1 << 8, bool)
_SPACES[[32, 9, 10, 11, 12, 13]] = True


def features(texts: list[str]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Borders of the texts in one run of characters, and for each kind of feature the buckets and the places where they begin.

    A space stands between texts, so no feature spans two of them. A pair of equal words is one feature for all words.
    """
    code = np.frombuffer(" ".join(["", *texts, ""]).encode("utf-32-le"), np.uint32)
    border = np.cumsum([1] + [len(t) + 1 for t in texts])
    space = _SPACES[np.minimum(code, 255)]
    starts, ends = common.runs(~space)
    words = common.word_hashes(code, starts, ends)
    out = [(words, starts)]
    if len(words) > 1:
        pairs = np.where(words[1:] == words[:-1], np.uint64(1), common.mix64(words[1:] * np.uint64(3) + words[:-1]))
        same = np.searchsorted(border, starts[1:], "right") == np.searchsorted(border, starts[:-1], "right")
        out.append((pairs[same], starts[:-1][same]))
    spaces = np.concatenate([[0], np.cumsum(space)])
    wide = np.where(space, np.uint64(32), code.astype(np.uint64)) + np.uint64(1)
    for n in GRAMS:
        m = len(code) - n + 1
        if m <= 0:
            continue
        # spaces stand at the borders of an n-gram alone
        at = np.flatnonzero(spaces[n - 1 : n - 1 + m] == spaces[1 : 1 + m])
        h = np.full(len(at), n, np.uint64)
        for k in range(n):
            h = (h ^ wide[at + k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        # a gram that begins with the space before a text's first word belongs to that text
        out.append((h, at + space[at]))
    return border, [((h >> np.uint64(20)) & np.uint64(BUCKETS - 1), at) for h, at in out]


class Model:
    """What scoring needs: a number for each bucket, and the constant."""

    def __init__(self, weight: np.ndarray, bias: float):
        self.weight, self.bias = weight.astype(np.float32), float(bias)

    def scores(self, texts: list[str]) -> np.ndarray:
        border, kinds = features(texts)
        total, count = np.zeros(len(texts)), np.zeros(len(texts))
        for buckets, at in kinds:
            cut = np.searchsorted(at, border)
            run = np.concatenate([[0.0], np.cumsum(self.weight[buckets.astype(np.int64)], dtype=np.float64)])
            total += run[cut[1:]] - run[cut[:-1]]
            count += np.diff(cut)
        return 1 / (1 + np.exp(-(total / np.maximum(count, 1) + self.bias)))


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets of a text's features, and the share of the features in each."""
    found = np.concatenate([b for b, _ in features([text])[1]])
    buckets, counts = np.unique(found.astype(np.int32), return_counts=True)
    return buckets, (counts / max(1, counts.sum())).astype(np.float32)


def train(texts: list[str], labels: list[int]) -> Model:
    """Stochastic gradient descent on the averaged vectors and the softmax layer; the same rows give the same model.

    Without rows the model says 0.5 of every text; with one label alone it learns that label.
    """
    rng = np.random.default_rng(SEED)
    bags = [bag(text) for text in texts]
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    layer, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    wanted = np.eye(2, dtype=np.float32)[np.asarray(labels, np.int64)] if labels else np.zeros((0, 2), np.float32)
    steps, step = max(1, EPOCHS * len(bags)), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(bags)):
            rate = np.float32(RATE * (1 - step / steps))
            step += 1
            buckets, share = bags[k]
            own = vectors[buckets]
            hidden = share @ own
            z = hidden @ layer + bias
            p = np.exp(z - z.max())
            off = p / p.sum() - wanted[k]
            back = layer @ off
            layer -= rate * np.outer(hidden, off)
            bias -= np.float32(0.1) * rate * off
            # as in published trainers, each feature takes the whole gradient rather than its share
            vectors[buckets] = own - (rate * np.minimum(share * len(buckets), 4))[:, None] * back
    return Model(vectors @ (layer[:, 1] - layer[:, 0]), bias[1] - bias[0])


def labelled_sample(docs: DataFrame, labels: DataFrame, training: Column, label_col: str = "quality") -> tuple[list[str], list[int]]:
    """Texts and labels of SAMPLE_ROWS labelled documents, those first in the order of a hash of their id.

    Which rows is settled in the narrow table of labels; the whole texts then come by one read of the documents. Of
    several labels for an id the highest holds; of several documents with an id that with the least hash of its text is
    taken, before anything reaches the driver.
    """
    key = F.xxhash64("doc_id", F.lit(SEED))
    marked = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where(training)
    chosen = marked.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(key, "doc_id").limit(SAMPLE_ROWS)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = narrow.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    found = sorted((r.doc_id, r.text, r.label) for r in rows.toLocalIterator())
    return [t for _, t, _ in found], [int(k == 1) for _, _, k in found]


SCHEMA = "doc_id long, score double"


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of each row, without a shuffle.

    A text without a word, or null, has the score of the constant alone. Ids may be null or repeated, and each row gets
    its own result. A long text is taken whole, in a slice of its own.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, at = common.utf8(batch.column(1))
            for low, high in common.slices(at):
                texts = [t or "" for t in batch.column(1).slice(low, high - low).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(sent.value.scores(texts))], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(common.released(scored), SCHEMA)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(fold(doc_id, 4) == 2, F.lit(False))


def quality_of(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of each row; labels of held-out rows are never read for training."""
    out = score(docs, train(*labelled_sample(docs, labels, ~held_out(F.col("doc_id")))))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
