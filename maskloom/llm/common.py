"""Shared pieces of the training-data operators: scratch tables, Arrow text access, hashing."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker handles at once.
CHUNK_BYTES = 1 << 20
#: White space of the word rules: space and the five control characters 9 to 13.
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_MUL = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93  # odd, so that it has an inverse modulo 2**64


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a single process makes one of its own; a cluster must name it."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        at = "file://" + tempfile.mkdtemp(prefix="maskloom-")
        spark.conf.set("spark.checkpoint.dir", at)
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def materialize(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there, and lost executors lose nothing.

    The table goes when the driver ends, or before by drop_table().
    """
    spark = df.sparkSession
    name = f"{shared_dir(spark)}/maskloom/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(name)
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(name)


def drop_table(*tables: DataFrame) -> None:
    """Deletes the files of materialized tables that nothing needs any more."""
    for df in tables:
        jvm = df.sparkSession._jvm
        conf = df.sparkSession._jsparkSession.sessionState().newHadoopConf()
        for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()[:1]}:
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(conf).delete(path, True)


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Bounds the rows that Arrow hands to a Python worker at once, for plans whose rows are whole texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(name: str = "text") -> Column:
    """The text column as string, null as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def release() -> None:
    """Hands the memory that this process has freed back to the system: Arrow's pool and the allocator keep it otherwise."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc alone
    if trim is not None:
        trim(0)


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A worker's function that releases memory once its task has ended, as idle workers stay for later tasks beside the JVM."""

    def whole(batches):
        yield from run(batches)
        release()

    return whole


def blocks(off: np.ndarray, most: int = CHUNK_BYTES):
    """Ranges (from, to) of rows with about `most` units each, by the rows' offsets; a longer row is a range of its own."""
    at = 0
    while at < len(off) - 1:
        to = max(at + 1, int(np.searchsorted(off, off[at] + most, side="right")) - 1)
        yield at, to
        at = to


def slices(batch: pa.RecordBatch, column: str, most: int = CHUNK_BYTES):
    """Parts of a batch with about `most` bytes of the column each; a longer value is a part of its own."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    for a, b in blocks(np.concatenate([[0], np.cumsum(sizes)]), most):
        yield batch.slice(a, b - a)


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text column and the offsets of its rows (one more than rows); nulls are empty."""
    kind = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    array = column.cast(kind)
    if array.null_count:
        array = pc.fill_null(array, b"" if kind == pa.large_binary() else "")
    _, offsets, data = array.buffers()
    off = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def column(batch: pa.RecordBatch, name: str):
    return batch.column(batch.schema.get_field_index(name))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, n of each at least; the longest so far are kept."""
    if len(_POWERS[0]) < n:
        n = -(-n >> 18) << 18
        for i, x in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            all_x = np.full(n, x, np.uint64)
            all_x[0] = 1
            _POWERS[i] = np.cumprod(all_x, dtype=np.uint64)
    return _POWERS


class Prefix:
    """Hashes of any byte ranges of one buffer, from prefix sums of a polynomial modulo 2**64."""

    def __init__(self, raw: np.ndarray):
        up, self.down = _powers(len(raw) + 1)
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Equal bytes have equal values; the length counts too."""
        h = (self.sums[end] - self.sums[start]) * self.down[start]
        return mix(h ^ ((end - start).astype(np.uint64) * _MUL))

    def grams(self, k: int) -> np.ndarray:
        """Hashes of all k-byte strings, by start."""
        n = len(self.sums) - k
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((self.sums[k:] - self.sums[:n]) * self.down[:n] ^ np.uint64(k * int(_MUL) & (1 << 64) - 1))


def words(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all rows, and for each row the index of its first word (one more than rows)."""
    if not len(raw):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(off), np.int64)
    inside = ~SPACES[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[off] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | edge[1:-1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(s, off)


def shingle_sets(raw: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit values of the k-word shingles of each row (A-Z lower-cased), and their row offsets.

    A row of fewer words has its whole word sequence as its one shingle; a row without words has none. Rows are
    taken about CHUNK_BYTES at a time, as hashing takes many times a text's bytes.
    """
    parts = [_shingle_sets(raw[off[a] : off[b]], off[a : b + 1] - off[a], k) for a, b in blocks(off)]
    return np.concatenate([np.zeros(0, np.uint64), *[v for v, _ in parts]]), np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *[n for _, n in parts]]))])


def _shingle_sets(raw: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The values of all rows, and the size of each row's set."""
    low = LOWER[raw]
    s, e, first = words(low, off)
    sets, sizes = [], np.zeros(len(off) - 1, np.int64)
    if len(s):
        h = Prefix(low)(s, e)
        n = len(h) - k + 1
        full = np.zeros(0, np.uint64)
        if n > 0:
            full = h[:n].copy()
            for i in range(1, k):
                full = mix(full * _MUL + h[i : i + n])
        for row in range(len(sizes)):
            a, b = first[row], first[row + 1]
            if b - a >= k:
                own = np.unique(full[a : b - k + 1])
            elif b > a:
                own = np.array([b - a], np.uint64)
                for x in range(a, b):
                    own = mix(own * _MUL + h[x])
            else:
                continue
            sets.append(own)
            sizes[row] = len(own)
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), sizes


def minhashes(values: np.ndarray, off: np.ndarray, t: int, seed: int = 1) -> np.ndarray:
    """t minwise values (uint32) of each row's set; rows without values have the largest value throughout."""
    rng = np.random.default_rng(seed)
    a = rng.integers(1 << 62, size=t, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(1 << 63, size=t, dtype=np.uint64)
    out = np.full((len(off) - 1, t), 0xFFFFFFFF, np.uint32)
    for x, y in blocks(off):
        some = x + np.flatnonzero(off[x + 1 : y + 1] > off[x:y])
        if len(some):
            own, at = values[off[x] : off[y]], off[some] - off[x]
            for i in range(t):
                out[some, i] = np.minimum.reduceat(((own ^ b[i]) * a[i]) >> np.uint64(32), at).astype(np.uint32)
    return out


def components(edges: DataFrame, name: str, most: int = 40) -> DataFrame:
    """(node, comp): the smallest node that each node of the links (a, b) reaches.

    Alternating large-star and small-star rounds, until all links are stars; links that are stars from the start need none. Every round
    is two aggregations and two joins on the node, and ends in a table in the shared folder; only a count comes to the driver, which
    holds what Spark keeps of each round's plans and tasks.
    A node of very many links meets them in a join whose sides are dealt for it alone, so that Spark can split it.
    """
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    e = materialize(e, name)
    for _ in range(most):
        if _stars(e):
            break
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")).repartition(partitions(edges.sparkSession))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m")).repartition(partitions(edges.sparkSession))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*")
        after = materialize(small.filter("a <> b").distinct(), name)
        drop_table(e)
        e = after
    else:
        raise RuntimeError(f"links of {name} did not settle in {most} rounds")
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(roots)


def _stars(links: DataFrame) -> bool:
    """Whether distinct links (a, b), a > b, are stars: each a has one b, and no b is an a. Then b is the least of what it is connected with."""
    none = F.lit(None).cast(links.schema["b"].dataType)
    ends = F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("to")), F.struct(F.col("b").alias("node"), none.alias("to")))
    nodes = links.select(F.explode(ends).alias("x")).select("x.*").groupBy("node").agg(F.count("to").alias("up"), F.count("*").alias("n"))
    return nodes.filter("up > 1 or up = 1 and n > 1").agg(F.count("*")).first()[0] == 0
