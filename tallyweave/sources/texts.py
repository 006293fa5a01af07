"""Texts of records in files of the shared folder. What is joined carries where a record's texts lie, and they are read where
they are compared: a text is written once and not sent with each pair that it is in."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tallyweave.sources import shared

#: Rows whose texts are read at once.
AT_ONCE = 256
_PLACE = ("text_file", "text_at", "text_sizes")


def put(rows: DataFrame, key: str) -> DataFrame:
    """The key and the place of each row, whose other columns are strings. They are written at once and go when the driver ends."""
    spark, names = rows.sparkSession, [c for c in rows.columns if c != key]
    folder = shared.fresh_folder(spark, "texts")
    shared.make_folder(folder)
    shared.remove_at_end(spark, folder)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, at = f"{folder}/{uuid.uuid4().hex}", 0
        with shared.SharedWriter(path) as file:
            for batch in batches:
                for low in range(0, len(batch), AT_ONCE):
                    part = batch.slice(low, AT_ONCE)
                    rows = [[None if t is None else t.encode() for t in r.values()] for r in part.select(names).to_pylist()]
                    sizes = [[-1 if t is None else len(t) for t in r] for r in rows]
                    whole = [b"".join(t for t in r if t is not None) for r in rows]
                    ends = at + np.cumsum([len(w) for w in whole])
                    file.write(b"".join(whole))
                    columns = [part.column(key), pa.array([path] * len(part)), pa.array(ends - [len(w) for w in whole], pa.int64()), pa.array(sizes, pa.list_(pa.int32()))]
                    yield pa.RecordBatch.from_arrays(columns, names=[key, *_PLACE])
                    at = int(ends[-1])

    return shared.checkpoint(rows.mapInArrow(shared.released(work), f"{key} string, text_file string, text_at long, text_sizes array<int>"))


def get(rows: DataFrame, names: list[str]) -> DataFrame:
    """Rows with the place of their texts, and those in its stead, in the order in which `put` had them."""
    kept = [f for f in rows.schema.fields if f.name not in _PLACE]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files: dict[str, object] = {}
        try:
            for batch in batches:
                for low in range(0, len(batch), AT_ONCE):
                    part = batch.slice(low, AT_ONCE)
                    found: list[list[str | None]] = [[] for _ in names]
                    for path, at, sizes in zip(*(part.column(c).to_pylist() for c in _PLACE), strict=True):
                        if path not in files:
                            files[path] = shared.open_shared(path)
                        files[path].seek(at)
                        data, begin = files[path].read(sum(max(n, 0) for n in sizes)), 0
                        for own, n in zip(found, sizes, strict=True):
                            own.append(data[begin : begin + n].decode() if n >= 0 else None)
                            begin += max(n, 0)
                    columns = [part.column(f.name) for f in kept] + [pa.array(own, pa.string()) for own in found]
                    yield pa.RecordBatch.from_arrays(columns, names=[*(f.name for f in kept), *names])
        finally:
            for file in files.values():
                file.close()

    return rows.mapInArrow(shared.released(work), T.StructType([*kept, *(T.StructField(n, T.StringType()) for n in names)]))
