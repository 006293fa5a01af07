"""Token ids of documents in sorted-string-table shards, written and read back.

A shard holds the documents of one range of ids in ascending order. Its parts, in file order:

* data blocks, each compressed with zstandard: entries of (bytes shared with the key before, bytes of own key, bytes of
  value) as varints, then the rest of the key and the value. A value is the document's ids, 2 bytes each where the
  vocabulary allows, else 4, little-endian;
* a Bloom filter of all keys;
* the sparse index: of each block the first key, the place, the sizes, the documents and the ids before it;
* a footer of fixed length with the places of filter and index, the counts and the magic bytes.

A key is 13 bytes that sort as the documents do: null before all, the id with its sign bit flipped, big-endian, and the
count of earlier rows with that id, so that repeated ids stay apart (rows of one id go by a hash of their text).
"""

from __future__ import annotations

import bisect
import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm import common

MAGIC = b"TWSSTAB1"
FOOTER = struct.Struct("<QQQQQQB7x8s")
BLOCK_BYTES = 1 << 16
BLOOM_BITS, BLOOM_HASHES = 10, 7
#: Distinct pieces of text that a worker remembers, the first that it meets, and the most characters of each; others, and
#: longer ones as in texts without spaces, are forgotten after the batch that they stand in. After so many batches it
#: begins anew, as other ranges of ids may have other words.
CACHE_UNITS, CACHE_CHARS, CACHE_BATCHES = 700_000, 64, 50
#: Bytes of text that are encoded at once: the more, the more often its pieces repeat.
BATCH_BYTES = 5 << 20


#: The characters that stand for bytes in a byte-level vocabulary: printable ones themselves, the others those from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_CHARS = {b: chr(b) for b in _PRINTABLE} | {b: chr(256 + k) for k, b in enumerate(sorted({*range(256)} - {*_PRINTABLE}))}


class UnitEncoder:
    """Ids of whole texts by the tokenizers library, which sees each distinct piece of text once.

    A byte-level pre-tokenizer never joins a character with a space after it unless the character is white space too,
    so the ids of a text are those of its pieces, cut before such spaces. Pieces repeat; their ids are remembered.
    A text that holds an added token goes to the library whole.
    """

    def __init__(self, model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(model)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.kind = np.dtype("<u2") if max(vocabulary.values()) < 1 << 16 else np.dtype("<u4")
        self.lengths = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.lengths[i] = len(token)  # a byte-level token has a character for each byte
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added)) or r"(?!)")
        form = json.loads(model)
        usual = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        self.plain_form = not form.get("normalizer") and usual.items() <= (form.get("pre_tokenizer") or {}).items()
        self.letters: dict[str, bool] = {}
        self.known: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.passing: list[str] = []
        self.batches = 0

    _unsafe = re.compile(r"\s ")
    _cuts = re.compile(r"(?<=\S)(?= )")

    def units(self, text: str) -> list[str]:
        """Pieces of a text; all but the first begin with a space that is left out."""
        if self._unsafe.search(text):
            first, *rest = self._cuts.split(text)
            return [first, *(x[1:] for x in rest)]
        return text.split(" ")

    def plain(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def parts(self, unit: str) -> list[str] | None:
        """A unit with its space, cut before line ends and between letters and closing marks; None where that isn't safe."""
        out = []
        for k, line in enumerate(unit.split("\n")):
            if not line or line[-1].isspace() or line[0].isspace():
                return None
            head = line.rstrip(self._marks)
            if head is not line and head != line and head.isalpha():
                out += [("\n" if k else " ") + head, line[len(head) :]]
            else:
                out.append(("\n" if k else " ") + line)
        return out

    #: Marks that are neither letters, digits, white space nor part of a contraction.
    _marks = ".,;:!?#$%&*|"

    def words(self, run: list[str]) -> None:
        """Learn words of letters that follow a space. The library would find each to be one token to merge, so it gets the
        characters that stand for their bytes, cut at spaces alone; words of letters that it doesn't take for such go the usual way."""
        from tokenizers import pre_tokenizers

        for c in set("".join(run)) - self.letters.keys() if self.plain_form else ():
            self.letters[c] = len(self.tokenizer.pre_tokenizer.pre_tokenize_str(f" a{c}a")) == 1
        odd = {c for c, is_letter in self.letters.items() if not is_letter}
        plain = ([w for w in run if odd.isdisjoint(w)] if odd else run) if self.plain_form else []
        if len(plain) < len(run):
            self.together([f" {w}" for w in run if not plain or not odd.isdisjoint(w)], self.known, 1)
        usual, width = self.tokenizer.pre_tokenizer, self.kind.itemsize
        self.tokenizer.pre_tokenizer = pre_tokenizers.Split(_BYTE_CHARS[32], "merged_with_next")
        try:
            for low in range(0, len(plain), 1 << 12):
                part = plain[low : low + (1 << 12)]
                whole = (" " + " ".join(part)).encode()
                ids = np.asarray(self.tokenizer.encode_batch_fast([whole.decode("latin-1").translate(_BYTE_CHARS)], add_special_tokens=False)[0].ids, self.kind)
                ends = np.append(np.flatnonzero(np.frombuffer(whole, np.uint8) == 32)[1:], len(whole))
                cuts = ((np.searchsorted(np.cumsum(self.lengths[ids]), ends) + 1) * width).tolist()
                raw = ids.tobytes()
                self.known.update(zip(part, (raw[begin:end] for begin, end in zip([0, *cuts[:-1]], cuts, strict=True)), strict=True))
        finally:
            self.tokenizer.pre_tokenizer = usual

    def together(self, run: list[str], into: dict[str, bytes], cut: int) -> None:
        """Ids of strings that each begin a token, by one call; they go into a dict under the strings from place `cut` on."""
        for low in range(0, len(run), 1 << 12):
            part = run[low : low + (1 << 12)]
            whole = "".join(part)
            ids = np.asarray(self.tokenizer.encode_batch_fast([whole], add_special_tokens=False)[0].ids, self.kind)
            ends = np.cumsum([len(p) for p in part] if whole.isascii() else [len(p.encode()) for p in part])
            cuts = np.searchsorted(np.cumsum(self.lengths[ids]), ends) + 1
            raw, width, begin = ids.tobytes(), self.kind.itemsize, 0
            for p, end in zip(part, (cuts * width).tolist(), strict=True):
                into[p[cut:]] = raw[begin:end]
                begin = end

    def learn(self, missing: list[str]) -> None:
        if len(self.pieces) > CACHE_UNITS // 4:
            self.pieces = {}
        cut: dict[str, list[str]] = {}
        marked: list[tuple[str, str, str]] = []
        words: dict[str, None] = {}
        wanted: set[str] = set()
        self.passing = list(missing) if len(self.known) > CACHE_UNITS else [unit for unit in missing if len(unit) > CACHE_CHARS or not unit or unit[-1].isspace()]
        for unit in missing:
            if unit.isalpha():
                words[unit] = None
            elif (head := unit.rstrip(self._marks)) != unit and head.isalpha():  # its word may be known already
                tail = unit[len(head) :]
                marked.append((unit, head, tail))
                if head not in self.known:
                    words[head] = None
                    if len(self.known) > CACHE_UNITS or len(head) > CACHE_CHARS:
                        self.passing.append(head)
                if tail not in self.pieces:
                    self.pieces[tail] = self.plain(tail)
            elif (parts := self.parts(unit)) is None:
                self.known[unit] = self.plain(" " + unit)
            else:
                cut[unit] = parts
                wanted.update(parts)
        if words:
            self.words(list(words))
        for unit, head, tail in marked:
            self.known[unit] = self.known[head] + self.pieces[tail]
        new = [p for p in wanted if p not in self.pieces]
        self.together([p for p in new if p[0] == " " or p[0] == "\n"], self.pieces, 0)
        for p in new:
            if p[0] != " " and p[0] != "\n":
                self.pieces[p] = self.plain(p)
        for unit, parts in cut.items():
            self.known[unit] = self.pieces[parts[0]] if len(parts) == 1 else b"".join(map(self.pieces.__getitem__, parts))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text. The pieces of all texts are numbered at once, and their ids laid out by number; texts that hold
        white space before a space, or an added token, go by themselves."""
        if not texts:
            return []
        self.batches += 1
        if self.batches % CACHE_BATCHES == 0:
            self.known = {}
        cut = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        places, pieces = cut.offsets.to_numpy(), cut.values.dictionary_encode()
        number, names = pieces.indices.to_numpy(), pieces.dictionary.to_pylist()
        found = list(map(self.known.get, names))
        new = [k for k, ids in enumerate(found) if ids is None]
        first, last = places[:-1], places[1:] - 1
        apart = np.zeros(len(texts), bool)
        if blank := [k for k in new if not names[k] or names[k][-1].isspace()]:  # never among those that are kept
            unsafe = np.zeros(len(names), bool)
            unsafe[blank] = True
            unsafe = unsafe[number]
            unsafe[last] = False  # no space follows it
            unsafe[first] &= np.fromiter((names[k] != "" for k in number[first].tolist()), bool, len(texts))
            apart = np.logical_or.reduceat(unsafe, first)
        apart |= np.fromiter((self.added.search(t) is not None for t in texts), bool, len(texts))
        cuts = {k: None if self.added.search(texts[k]) else self.units(texts[k]) for k in np.flatnonzero(apart).tolist()}
        inner = np.repeat(~apart, np.diff(places))
        inner[first] = False  # no space before it
        used = np.zeros(len(names), bool)
        used[number[inner]] = True
        new = [k for k in new if used[k]]
        wanted = dict.fromkeys([names[k] for k in new])
        for units in cuts.values():
            wanted.update(dict.fromkeys(u for u in units[1:] if u not in self.known) if units else {})
        self.learn(list(wanted))
        for k in new:
            found[k] = self.known[names[k]]
        found = [ids or b"" for ids in found]
        size = np.fromiter(map(len, found), np.int64, len(found)) // self.kind.itemsize
        begin, ids = np.cumsum(size) - size, np.frombuffer(b"".join(found), self.kind)
        del found, cut, pieces
        long = np.where(inner, size[number], 0)
        ends = np.concatenate([[0], np.cumsum(long)])
        opening = number[first].tolist()

        def laid_out(low: int, high: int) -> bytes:
            units = slice(places[low], places[high])
            start, stop = ends[places[low]], ends[places[high]]
            return ids[np.repeat(begin[number[units]] - ends[:-1][units], long[units]) + np.arange(start, stop)].tobytes()

        out = []
        for k, text in enumerate(texts):
            if k % 64 == 0:
                raw, at = laid_out(k, min(k + 64, len(texts))), ((ends[places[k : k + 65]] - ends[places[k]]) * self.kind.itemsize).tolist()
            if k not in cuts:
                out.append((self.plain(names[opening[k]]) if names[opening[k]] else b"") + raw[at[k % 64] : at[k % 64 + 1]])
            elif (units := cuts[k]) is None:
                out.append(self.plain(text))
            else:
                out.append((self.plain(units[0]) if units[0] else b"") + b"".join(map(self.known.__getitem__, units[1:])))
        self.forget()
        return out

    def forget(self) -> None:
        """Drop the pieces of a batch that aren't kept."""
        for unit in self.passing:
            if len(unit) > CACHE_CHARS:
                for part in self.parts(unit) or ():
                    self.pieces.pop(part, None)
            self.known.pop(unit, None)
        self.passing = []


def encoder(model: bytes) -> UnitEncoder:
    """One encoder for each vocabulary and Python worker."""
    return common.held(f"sstable {zlib.crc32(model)}", lambda: UnitEncoder(model))


def key_of(doc_id: int | None, nth: int = 0) -> bytes:
    return bytes(13) if doc_id is None else b"\x01" + ((doc_id + (1 << 63)) & ((1 << 64) - 1)).to_bytes(8, "big") + nth.to_bytes(4, "big")


def id_of(key: bytes) -> int | None:
    return int.from_bytes(key[1:9], "big") - (1 << 63) if key[0] else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _bloom_places(keys: list[bytes], bits: int) -> np.ndarray:
    """Where each key sets its bits; a row for each key."""
    low = np.array([zlib.crc32(k) for k in keys], np.uint64)
    high = np.array([zlib.crc32(k, 0x5BD1E995) for k in keys], np.uint64)
    a, b = common.mix64(low << np.uint64(32) | high), common.mix64(high << np.uint64(32) | low) | np.uint64(1)
    return (a[:, None] + np.arange(BLOOM_HASHES, dtype=np.uint64) * b[:, None]) % np.uint64(bits)


class Writer:
    """Writes one shard; keys must come in ascending order."""

    def __init__(self, out, width: int):
        self.out, self.width = out, width
        self.block, self.before, self.first = bytearray(), b"", b""
        self.index: list[tuple[bytes, int, int, int, int, int]] = []
        self.keys: list[bytes] = []
        self.at = self.n_ids = self.block_docs = self.block_ids = 0
        self.press = zstandard.ZstdCompressor(level=1)

    def add(self, key: bytes, value: bytes) -> None:
        if self.keys and key <= self.keys[-1]:
            raise ValueError("keys must ascend")
        if not self.block:
            self.first, self.before = key, b""
            self.block_docs, self.block_ids = len(self.keys), self.n_ids
        shared = len(os.path.commonprefix([key, self.before]))
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.before = key
        self.keys.append(key)
        self.n_ids += len(value) // self.width
        if len(self.block) >= BLOCK_BYTES:
            self.flush()

    def flush(self) -> None:
        if self.block:
            data = self.press.compress(bytes(self.block))
            self.out.write(data)
            self.index.append((self.first, self.at, len(data), len(self.block), self.block_docs, self.block_ids))
            self.at += len(data)
            self.block = bytearray()

    def close(self) -> None:
        self.flush()
        bits = max(64, len(self.keys) * BLOOM_BITS)
        table = np.zeros(-(-bits // 8) * 8, np.uint8)
        for low in range(0, len(self.keys), 1 << 14):
            table[_bloom_places(self.keys[low : low + (1 << 14)], bits).astype(np.int64)] = 1
        bloom = bits.to_bytes(8, "little") + np.packbits(table).tobytes()
        index = b"".join(first + struct.pack("<QQQQQ", *rest) for first, *rest in self.index)
        self.out.write(bloom)
        self.out.write(index)
        self.out.write(FOOTER.pack(self.at, len(bloom), self.at + len(bloom), len(index), len(self.keys), self.n_ids, self.width, MAGIC))


class Reader:
    """Reads one shard: everything in order, or one key by filter, index and block."""

    ENTRY = 13 + 40

    def __init__(self, path: str):
        self.file = common.open_shared(path)
        size = self.file.seek(0, 2)
        if size < FOOTER.size:
            raise ValueError(f"{path} is too short for a shard")
        self.file.seek(size - FOOTER.size)
        bloom_at, bloom_size, index_at, index_size, self.n_docs, self.n_ids, self.width, magic = FOOTER.unpack(self.file.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is no shard")
        self.file.seek(bloom_at)
        bloom = self.file.read(bloom_size)
        self.bits = int.from_bytes(bloom[:8], "little")
        self.bloom = np.unpackbits(np.frombuffer(bloom, np.uint8, offset=8))
        self.file.seek(index_at)
        raw = self.file.read(index_size)
        self.firsts = [raw[i : i + 13] for i in range(0, len(raw), self.ENTRY)]
        self.places = [struct.unpack_from("<QQQQQ", raw, i + 13) for i in range(0, len(raw), self.ENTRY)]
        self.kind = np.dtype(f"<u{self.width}")

    def __enter__(self) -> Reader:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()

    def block(self, k: int) -> Iterator[tuple[bytes, bytes]]:
        at, packed, size, _, _ = self.places[k]
        self.file.seek(at)
        data = zstandard.ZstdDecompressor().decompress(self.file.read(packed), max_output_size=size)
        key, i = b"", 0
        while i < len(data):
            shared, i = _read_varint(data, i)
            own, i = _read_varint(data, i)
            length, i = _read_varint(data, i)
            key = key[:shared] + data[i : i + own]
            i += own
            yield key, data[i : i + length]
            i += length

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for k in range(len(self.firsts)):
            yield from self.block(k)

    def get(self, doc_id: int | None, nth: int = 0) -> np.ndarray | None:
        """The ids of a document, or None where the shard hasn't got it."""
        key = key_of(doc_id, nth)
        if not self.firsts or not self.bloom[_bloom_places([key], self.bits).astype(np.int64)].all():
            return None
        k = bisect.bisect_right(self.firsts, key) - 1
        return next((np.frombuffer(v, self.kind) for x, v in self.block(k) if x == key), None) if k >= 0 else None


#: The most tasks that shards are dealt to when they are read.
MOST_TASKS = 100_000
MANIFEST = "shard int, path string, n_docs long, n_ids long, first_id long, last_id long, n_bytes long"


def write(docs: DataFrame, folder: str, model: bytes, end_id: int | None = 0, id_col: str = "doc_id", text_col: str = "text") -> list[dict]:
    """Encode the texts and write them as shards in a shared folder; returns a row for each shard, in order.

    Ranges of ids are dealt by Spark, so no task holds more than one range; rows of one id are dealt by a hash of their
    text beside it. A null text is empty and gets the end id alone. An empty table gives no shard.
    """
    spark = docs.sparkSession
    common.make_folder(folder)
    sent = spark.sparkContext.broadcast(model)

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        path = f"{folder}/shard-{number:06d}.sst"
        encode = encoder(sent.value)
        ending = b"" if end_id is None else np.array([end_id], encode.kind).tobytes()
        last: object = ()
        nth, ids = 0, []
        batch = next(filter(len, batches), None)
        if batch is None:
            return
        with common.SharedWriter(path) as out:
            writer = Writer(out, encode.kind.itemsize)
            while batch is not None:
                _, at = common.utf8(batch.column(1))
                for low, high in common.slices(at, BATCH_BYTES):
                    part = batch.slice(low, high - low)
                    values = encode.encode([t or "" for t in part.column(1).to_pylist()])
                    for doc_id, value in zip(part.column(0).to_pylist(), values, strict=True):
                        nth = nth + 1 if doc_id == last else 0
                        last = doc_id
                        key = key_of(doc_id, nth) if doc_id is not None else bytes(9) + nth.to_bytes(4, "big")
                        writer.add(key, value + ending)
                batch = next(filter(len, batches), None)
            writer.close()
            ids = [id_of(writer.keys[0]), id_of(writer.keys[-1])]
        yield pa.RecordBatch.from_pylist(
            [{"shard": number, "path": path, "n_docs": len(writer.keys), "n_ids": writer.n_ids, "first_id": ids[0], "last_id": ids[1], "n_bytes": out.size}],
            schema=pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("n_bytes", pa.int64())]),
        )

    rows = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).cast("string").alias("t"))
    dealt = rows.repartitionByRange(F.col("k"), F.xxhash64("t")).sortWithinPartitions(F.col("k"), F.xxhash64("t"))
    return sorted((r.asDict() for r in dealt.mapInArrow(common.released(shard), MANIFEST).collect()), key=lambda r: r["shard"])


READ = "doc_id long, shard int, start long, n_tokens long, ids_crc32 long"


def read(spark: SparkSession, manifest: list[dict], with_ids: bool = False) -> DataFrame:
    """The documents of all shards, whose places are rows that are dealt evenly; `start` counts the ids of all documents before.

    `ids_crc32` is the unsigned CRC-32 of the ids as little-endian unsigned 32-bit integers; with_ids adds them as an array.
    """
    before = np.concatenate([[0], np.cumsum([m["n_ids"] for m in manifest])]).astype(np.int64).tolist()
    shards = [(m["shard"], m["path"], b) for m, b in zip(manifest, before[:-1], strict=True)]
    schema = READ + (", ids array<long>" if with_ids else "")

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, path, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with Reader(path) as reader:
                    for block in range(len(reader.firsts)):
                        rows: dict[str, list] = {"doc_id": [], "shard": [], "start": [], "n_tokens": [], "ids_crc32": []} | ({"ids": []} if with_ids else {})
                        for key, value in reader.block(block):
                            ids = np.frombuffer(value, reader.kind)
                            rows["doc_id"].append(id_of(key))
                            rows["shard"].append(number)
                            rows["start"].append(start)
                            rows["n_tokens"].append(len(ids))
                            rows["ids_crc32"].append(zlib.crc32(ids.astype("<u4").tobytes()))
                            if with_ids:
                                rows["ids"].append(ids.astype(np.int64))
                            start += len(ids)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(rows[n], t) for n, t in (("doc_id", pa.int64()), ("shard", pa.int32()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()))] + ([pa.array(rows["ids"], pa.list_(pa.int64()))] if with_ids else []),
                            names=list(rows),
                        )

    if not shards:
        return spark.createDataFrame([], schema)
    places = spark.createDataFrame(shards, "shard int, path string, start long")
    return places.repartition(min(len(shards), MOST_TASKS)).mapInArrow(documents, schema)


def shards_of(docs: DataFrame, model: bytes, end_id: int | None = 0) -> DataFrame:
    """Write `docs` into a new shared folder and read the shards back."""
    spark = docs.sparkSession
    return read(spark, write(docs, common.fresh_folder(spark, "tokens"), model, end_id))
