"""Folds of each key's rows in order, for what depends on the order of arrival.

Rows are put in order in many tasks, by ranges of (key, seq), and packed into pieces of a few bytes a row. Only
pieces come to the task that folds a key, which reads them one by one: it never holds or sorts the key's rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sketchwell.functions.workers import reachable


def pieces(items: DataFrame, fields: dict[str, tuple[Column, str]]) -> DataFrame:
    """(key, part, data): the rows of items(key, seq, item) by seq, then item, as columns of numbers: name, (value, numpy type)."""
    reachable(items.sparkSession)
    types = [t for _, t in fields.values()]
    by = [F.col("key"), F.col("seq").asc_nulls_last()]
    rows = items.select("key", "seq", "item").repartitionByRange(*by).sortWithinPartitions(*by, "item")
    rows = rows.select("key", F.spark_partition_id().cast("long").alias("range"), *(c.cast("long").alias(name) for name, (c, _) in fields.items()))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = batch.column(0).dictionary_encode(null_encoding="encode").indices.to_numpy()
            starts = np.concatenate([[0], np.flatnonzero(np.diff(codes)) + 1])
            ends = [*starts[1:].tolist(), len(codes)]
            columns = [batch.column(2 + i).to_numpy(zero_copy_only=False).astype(t) for i, t in enumerate(types)]
            data = [b"".join(c[s:e].tobytes() for c in columns) for s, e in zip(starts.tolist(), ends)]
            parts = (int(batch.column(1)[0].as_py()) << 32) + number + np.arange(len(starts))
            number += len(starts)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(starts)), pa.array(parts), pa.array(data, pa.binary())], ["key", "part", "data"])

    kind = items.schema["key"].dataType.simpleString()
    return rows.mapInArrow(pack, f"key {kind}, part long, data binary")


def folded(pieces: DataFrame, types: list[str], fold: Callable[[Iterator[list[np.ndarray]]], Iterator[dict]], columns: str) -> DataFrame:
    """(key, columns) of each key: fold takes the pieces of a key, in order, as arrays, and yields columns of results."""
    tasks = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = pieces.schema["key"].dataType.simpleString()
    width = sum(np.dtype(t).itemsize for t in types)

    def arrays(data: bytes) -> list[np.ndarray]:
        n, at, out = len(data) // width, 0, []
        for t in types:
            out.append(np.frombuffer(data, t, n, at))
            at += n * np.dtype(t).itemsize
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((batch.column(0), i, batch.column(2)[i]) for batch in batches for i in range(batch.num_rows))
        held = next(rows, None)

        def of_key(key):
            nonlocal held
            while held is not None and held[0][held[1]].as_py() == key:
                yield arrays(held[2].as_py())
                held = next(rows, None)

        while held is not None:
            one = held[0].slice(held[1], 1)
            mine = of_key(one[0].as_py())
            for got in fold(mine):
                n = len(next(iter(got.values())))
                yield pa.RecordBatch.from_arrays([one.take(pa.array(np.zeros(n, np.int64))), *map(pa.array, got.values())], ["key", *got])
            for _ in mine:  # what a fold leaves
                pass

    return pieces.repartition(tasks, "key").sortWithinPartitions("key", "part").mapInArrow(run, f"key {kind}, {columns}")
