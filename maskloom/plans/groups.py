"""Groups of rows for Arrow workers: a partition comes sorted by its key, and a worker takes it group by group as it streams by."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame


def by_key(df: DataFrame, *key: str, order: tuple[str, ...] = ()) -> DataFrame:
    """Rows dealt by key and sorted by it in their partitions; the sort spills, so that no group must fit in memory."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *key).sortWithinPartitions(*key, *order)


def pieces(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """(key, rows): the rows of one group at a time, a group that goes on in the next batch in several pieces one after the other."""
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        new = np.zeros(n, bool)
        for c in key:
            v = b.column(c)
            new[1:] |= pc.fill_null(pc.not_equal(v.slice(1), v.slice(0, n - 1)), False).to_numpy(zero_copy_only=False) | (pc.is_null(v.slice(1)).to_numpy(zero_copy_only=False) != pc.is_null(v.slice(0, n - 1)).to_numpy(zero_copy_only=False))
        ends = [0, *np.flatnonzero(new).tolist(), n]
        values = [b.column(c).take(pa.array(ends[:-1])).to_pylist() for c in key]
        for i, k in enumerate(zip(*values, strict=True)):
            yield k, b.slice(ends[i], ends[i + 1] - ends[i])


def numbers(rows: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [rows.column(c).to_numpy(zero_copy_only=False) for c in names]


class Rows:
    """Gathers a key and arrays for each group, and gives them out in batches of about `most` rows."""

    def __init__(self, schema: pa.Schema, key: list[str], most: int = 50_000):
        self.schema, self.key, self.most, self.held, self.n = schema, key, most, [], 0

    def add(self, key: tuple, **columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        size = len(next(iter(columns.values())))
        if size:
            self.held.append((key, size, columns))
            self.n += size
        if self.n >= self.most:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            at = pa.array(np.repeat(np.arange(len(self.held)), [h[1] for h in self.held]))
            made = {c: pa.array([h[0][i] for h in self.held], self.schema.field(c).type).take(at) for i, c in enumerate(self.key)}
            made |= {c: pa.array(np.concatenate([h[2][c] for h in self.held]), self.schema.field(c).type) for c in self.held[0][2]}
            self.held, self.n = [], 0
            yield pa.RecordBatch.from_arrays([made[f.name] for f in self.schema], schema=self.schema)


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, *columns: str, most: int = 200_000) -> Iterator[tuple[pa.Array, np.ndarray, list[np.ndarray]]]:
    """(keys, first rows, columns): whole groups by one key, many at a time, of batches that come sorted by it; about `most` rows or one group at once.

    Columns are numbers without null.
    """
    held, size = [], 0

    def out(parts):
        t = pa.Table.from_batches(parts).combine_chunks()
        k = t[key].combine_chunks()
        k = k.chunk(0) if isinstance(k, pa.ChunkedArray) else k
        if any(t[c].null_count for c in columns):
            raise ValueError(f"a null among {', '.join(columns)}")
        first = np.flatnonzero(_new(k))
        return k.take(pa.array(first)), first, [t[c].to_numpy() for c in columns]

    def _new(k):
        new = np.ones(len(k), bool)
        null, v = k.is_null().to_numpy(zero_copy_only=False), pc.fill_null(k, 0).to_numpy(zero_copy_only=False)
        new[1:] = (v[1:] != v[:-1]) | (null[1:] != null[:-1])
        return new

    for b in batches:
        if not b.num_rows:
            continue
        last = int(np.flatnonzero(_new(b.column(key)))[-1])
        if size >= most and (last or b.column(key)[0].as_py() != held[-1].column(key)[0].as_py()):
            yield out([*held, b.slice(0, last)] if last else held)
            held, size = [], 0
            b = b.slice(last)
        held.append(b)
        size += b.num_rows
    if held:
        yield out(held)
