"""Removal of repeated 100-byte strings by a column-wise, multi-document suffix order.

Sorting every suffix of every document by one global structure is quadratic in the longest document
when built column by column. Two facts make columns short. Only strings of `span` bytes matter, and
each of them contains an anchor: the least hash of its k-byte grams. Equal strings have their anchor
in the same place, so strings are compared in fragments that are aligned on the anchors they share.

1. Every document gives its anchors, with the hash of the bytes around each that any string over the
   anchor can reach. An anchor with the same surroundings as an earlier one is repeated throughout.
2. Anchors whose hash occurs with several surroundings give the first of each as a fragment.
3. The fragments of one anchor are a small collection of documents. Column by column from the right, one
   symbol of each is inserted: the order of the suffixes (the collection's Burrows-Wheeler order) and the
   common prefixes of neighbours are updated from those of the column before, in files that are read and
   written in sequence. Where common prefixes reach `span`, all strings but the earliest are repeated.
4. An anchor with very many fragments is parted: its fragments go to collections of longer anchors.
"""

from __future__ import annotations

import itertools
import os
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskloom.llm import common

SPAN, GRAM = 100, 24
#: Fragments of one anchor up to which they are one collection; more are parted by longer anchors.
FRAGMENTS = 100_000
#: Rows of the sequential files that are in memory at once, and repeated strings that are held until they go out.
BLOCK, FOUND = 1 << 16, 1 << 20


def _slide(x: np.ndarray, w: int, least: bool) -> np.ndarray:
    """Minimum (or maximum) of x over w places from each place on, by doubling."""
    pick = np.minimum if least else np.maximum
    n, have, out = len(x) - w + 1, 1, x
    while have * 2 <= w:
        out = pick(out[: len(out) - have], out[have:])
        have *= 2
    return pick(out[:n], out[w - have : w - have + n])


def anchors(raw: np.ndarray, off: np.ndarray, span: int = SPAN, gram: int = GRAM):
    """(row, start, hash, around, left, right) of the anchors of all rows.

    An anchor is a gram whose hash is least in some string of `span` bytes (all of them on ties). left and right count
    the bytes before and from its start that strings over it can reach in its row; `around` is the hash of these.
    """
    none = np.zeros(0, np.int64)
    if len(raw) < span:
        return none, none, none.view(np.uint64), none.view(np.uint64), none, none
    prefix = common.Prefix(raw)
    full = prefix.grams(gram)
    order = (full >> np.uint64(33)).astype(np.uint32)
    w = span - gram + 1
    least = _slide(order, w, True)  # by string start
    lengths = np.diff(off)
    row_of = np.repeat(np.arange(len(lengths)), lengths)
    starts = np.arange(len(least))
    inside = off[1:][row_of[: len(least)]] - starts >= span
    least = np.where(inside, least.astype(np.int64), -1)
    reach = _slide(np.concatenate([np.full(w - 1, -1), least, np.full(w - 1, -1)]), w, False)[: len(order)]
    at = np.flatnonzero(reach == order)
    row = row_of[at]
    a = np.maximum(at - (w - 1), off[:-1][row])
    b = np.minimum(at + span, off[1:][row])
    return row, at - off[:-1][row], full[at], prefix(a, b) ^ ((at - a).astype(np.uint64) << np.uint64(7)), at - a, b - at


_ROW = "h bigint, c bigint, doc bigint, at bigint, lr int"


def _found(docs: DataFrame, span: int, gram: int) -> DataFrame:
    """Anchor rows (h, c, doc, at, lr); rows of repeats inside one worker's chunk come as intervals at once (h null, at and lr: start and length)."""

    def run(batches):
        for batch in batches:
            for part in common.slices(batch, "t"):
                raw, off = common.utf8(common.column(part, "t"))
                ids = common.column(part, "doc").to_numpy(zero_copy_only=False)
                row, at, h, c, left, right = anchors(raw, off, span, gram)
                if not len(row):
                    continue
                doc = ids[row]
                order = np.lexsort((at, doc, c, h))
                h, c, doc, at, left, right = (x[order] for x in (h, c, doc, at, left, right))
                again = np.zeros(len(h), bool)
                again[1:] = (h[1:] == h[:-1]) & (c[1:] == c[:-1])
                first = np.maximum.accumulate(np.where(again, 0, np.arange(len(h))))
                known = again & ((doc != doc[first]) | (at != at[first]))
                new = ~again
                made = [pa.array(h[new].view(np.int64)), pa.array(c[new].view(np.int64)), pa.array(doc[new]), pa.array(at[new]), pa.array((left[new] << 16 | right[new]).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(made, ["h", "c", "doc", "at", "lr"])
                if known.any():
                    d, s, e = _merged(doc[known], (at - left)[known], (at + right)[known])
                    none = pa.nulls(len(d), pa.int64())
                    yield pa.RecordBatch.from_arrays([none, none, pa.array(d), pa.array(s), pa.array((e - s).astype(np.int32))], ["h", "c", "doc", "at", "lr"])

    return docs.mapInArrow(run, _ROW)


def _merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Unions of the intervals of each document (start and end of a union may touch)."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    base = np.cumsum(np.diff(doc, prepend=doc[:1]) != 0)  # documents apart on one line
    wide = int(end.max()) + 2
    far = np.maximum.accumulate(end + base * wide) - base * wide
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] > far[:-1])
    at = np.flatnonzero(new)
    return doc[at], start[at], np.maximum.reduceat(end, at) if len(at) else end


_OUT = "kind int, h bigint, doc bigint, at bigint, lr int"


def _matched(rows: DataFrame) -> DataFrame:
    """(kind, h, doc, at, lr) from anchor rows sorted by (h, c, doc, at): kind 0 repeated intervals (at, lr: start and length), kind 1 fragments wanted.

    Only the state of the run before is held, so a hash of any number of rows streams through.
    """

    def run(batches):
        before = None  # h, c, and the first (doc, at) of that surrounding
        pending = None  # the first fragment of a hash of which one surrounding is known so far
        for batch in batches:
            valid = common.column(batch, "h").is_valid().to_numpy(zero_copy_only=False)
            if not valid.all():
                done = batch.filter(pa.array(~valid))
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(done.num_rows, np.int32)), *(common.column(done, x) for x in ("h", "doc", "at", "lr"))], ["kind", "h", "doc", "at", "lr"])
                batch = batch.filter(pa.array(valid))
            if not batch.num_rows:
                continue
            h, c, doc, at, lr = (common.column(batch, x).to_numpy() for x in ("h", "c", "doc", "at", "lr"))
            n = len(h)
            same_h, same = np.zeros(n, bool), np.zeros(n, bool)
            same_h[1:] = h[1:] == h[:-1]
            same[1:] = same_h[1:] & (c[1:] == c[:-1])
            if before is not None:
                same_h[0] = h[0] == before[0]
                same[0] = same_h[0] and c[0] == before[1]
            first = np.maximum.accumulate(np.where(same, -1, np.arange(n)))
            lead_doc, lead_at = doc[first], at[first]
            if before is not None:
                lead_doc, lead_at = np.where(first < 0, before[2], lead_doc), np.where(first < 0, before[3], lead_at)
            again = same & ((doc != lead_doc) | (at != lead_at))
            if again.any():
                left, right = lr[again] >> 16, lr[again] & 0xFFFF
                d, s, e = _merged(doc[again], at[again] - left, at[again] + right)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(d), np.int32)), pa.nulls(len(d), pa.int64()), pa.array(d), pa.array(s), pa.array((e - s).astype(np.int32))], ["kind", "h", "doc", "at", "lr"])
            new = np.flatnonzero(~same)
            if len(new):
                other = same_h[new]  # a second or later surrounding of its hash
                followed = np.zeros(len(new), bool)
                followed[:-1] = other[1:]
                want = new[other | followed]
                early = [pending] if pending is not None and other[0] else []
                rows = [np.concatenate([[p[i] for p in early], x[want]]).astype(x.dtype) for i, x in enumerate((h, doc, at, lr))]
                if len(rows[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(rows[0]), np.int32)), *map(pa.array, rows)], ["kind", "h", "doc", "at", "lr"])
                k = new[-1]
                pending = None if other[-1] else (h[k], doc[k], at[k], lr[k])
            before = (h[-1], c[-1], lead_doc[-1], lead_at[-1])

    return rows.mapInArrow(run, _OUT)


def _cut(joined: DataFrame) -> DataFrame:
    """(h, doc, at, left, frag): the bytes of the fragments wanted, from rows (doc, t, want)."""

    def run(batches):
        for batch in batches:
            for part in common.slices(batch, "t"):
                raw, off = common.utf8(common.column(part, "t"))
                data = raw.tobytes()
                want = common.column(part, "want")
                count = want.value_lengths().to_numpy(zero_copy_only=False)
                flat = want.flatten()
                h, at, lr = (flat.field(x).to_numpy(zero_copy_only=False) for x in ("h", "at", "lr"))
                row = np.repeat(np.arange(part.num_rows), count)
                left = lr >> 16
                a, b = off[:-1][row] + at - left, off[:-1][row] + at + (lr & 0xFFFF)
                frag = pa.array([data[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)], pa.binary())
                docs = common.column(part, "doc").to_numpy()[row]
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(docs), pa.array(at), pa.array(left.astype(np.int32)), frag], ["h", "doc", "at", "left", "frag"])

    return joined.mapInArrow(run, "h bigint, doc bigint, at bigint, left int, frag binary")


class Columns:
    """The symbols of a collection's fragments, column by column, in an unnamed file that belongs to the task and goes with it.

    Fragments are aligned; a place where one has no symbol holds 256, which equals nothing.
    """

    def __init__(self, file, width: int):
        self.file, self.width, self.blocks, self.rows = file, width, [], 0

    def add(self, raw: np.ndarray, off: np.ndarray, first: np.ndarray) -> None:
        """Appends fragments (bytes, offsets), each from its first column on."""
        for a in range(0, len(first), BLOCK):
            n = min(BLOCK, len(first) - a)
            length = np.diff(off[a : a + n + 1])
            row = np.repeat(np.arange(n), length)
            place = np.arange(off[a], off[a + n]) - np.repeat(off[a : a + n] - first[a : a + n], length)
            whole = np.full((self.width, n), 256, np.uint16)
            whole[place, row] = raw[off[a] : off[a + n]]
            self.blocks.append((self.file.seek(0, 2), n))
            self.file.write(whole.tobytes())
            self.rows += n

    def column(self, j: int) -> np.ndarray:
        parts = [np.frombuffer(os.pread(self.file.fileno(), 2 * n, at + 2 * n * j), np.uint16) for at, n in self.blocks]
        return np.concatenate(parts) if parts else np.zeros(0, np.uint16)


def _round(column: np.ndarray, old, new, span: int) -> None:
    """One symbol of every fragment goes in front of its suffix: from the files of order and common prefixes (old) those of the next column (new).

    The old order is read in sequence; each symbol has a stretch of the new files that is written in sequence. The common
    prefix with the neighbour above is one more than the least since the symbol was there last.
    """
    at = np.cumsum(np.bincount(column, minlength=257)) - np.bincount(column, minlength=257)
    since = np.full(257, -1, np.int64)  # least common prefix since each symbol's last place; -1 before its first
    for a in range(0, len(column), BLOCK):
        n = min(BLOCK, len(column) - a)
        order = np.frombuffer(os.pread(old[0].fileno(), 4 * n, 4 * a), np.int32)
        low = np.frombuffer(os.pread(old[1].fileno(), n, a), np.uint8).astype(np.int64)
        symbol = column[order]
        moved = np.argsort(symbol, kind="stable")
        s = symbol[moved]
        lead = np.ones(n, bool)
        lead[1:] = s[1:] != s[:-1]
        made = np.empty(n, np.int64)
        heads = np.flatnonzero(lead)
        made[heads] = np.minimum(np.minimum.accumulate(low)[moved[heads]], since[s[heads]])
        rest = np.flatnonzero(~lead)
        p, q = moved[rest - 1], moved[rest]
        made[rest] = low[q]
        apart = np.flatnonzero(q > p + 1)
        if len(apart):
            ends = np.stack([p[apart] + 1, q[apart] + 1], 1).ravel()
            made[rest[apart]] = np.minimum.reduceat(np.append(low, 0), ends)[::2]
        made = np.where(s == 256, 0, np.minimum(made + 1, span)).astype(np.uint8)
        tails = np.append(heads[1:], n) - 1
        after = np.append(np.minimum.accumulate(low[::-1])[::-1], span)
        since = np.minimum(since, low.min())
        since[s[tails]] = np.minimum(after[moved[tails] + 1], span)
        new_order = order[moved]
        if n == len(column):
            os.pwrite(new[0].fileno(), new_order.tobytes(), 0)
            os.pwrite(new[1].fileno(), made.tobytes(), 0)
            return
        for i, k in zip(heads, tails + 1, strict=True):
            os.pwrite(new[0].fileno(), new_order[i:k].tobytes(), 4 * int(at[s[i]]))
            os.pwrite(new[1].fileno(), made[i:k].tobytes(), int(at[s[i]]))
            at[s[i]] += k - i


def _again(files, n: int, span: int):
    """Rows whose string is that of a row before them: all of a run of common prefixes of `span` but its least. Runs may pass from block to block."""
    least = -1  # of the run that is open
    for a in range(0, n, BLOCK):
        size = min(BLOCK, n - a)
        low = np.frombuffer(os.pread(files[1].fileno(), size, a), np.uint8)
        order = np.frombuffer(os.pread(files[0].fileno(), 4 * size, 4 * a), np.int32)
        starts = np.flatnonzero(low < span)
        if len(starts) == size:
            least = int(order[-1])
            continue
        goes_on = not len(starts) or starts[0] > 0
        runs = np.concatenate([[0], starts]) if goes_on else starts
        first = np.minimum.reduceat(order, runs)
        yield order[order > np.repeat(first, np.diff(np.append(runs, size)))]
        if goes_on and least >= 0:
            yield np.array([max(least, int(first[0]))], np.int32)
            first = first.copy()
            first[0] = min(least, int(first[0]))
        least = int(first[-1])


def column_order(columns: Columns, span: int):
    """(column, rows whose string starting there occurs in an earlier row), for all columns from the right.

    Two pairs of files take turns: the order of all suffixes, and common prefixes of neighbours up to `span`. In memory are
    one column and one block of each file.
    """
    n = columns.rows
    with tempfile.TemporaryFile(buffering=0) as a, tempfile.TemporaryFile(buffering=0) as b, tempfile.TemporaryFile(buffering=0) as c, tempfile.TemporaryFile(buffering=0) as d:
        old, new = (a, b), (c, d)
        for at in range(0, n, BLOCK):
            size = min(BLOCK, n - at)
            os.pwrite(a.fileno(), np.arange(at, at + size, dtype=np.int32).tobytes(), 4 * at)
            os.pwrite(b.fileno(), bytes(size), at)
        for j in range(columns.width - 1, -1, -1):
            _round(columns.column(j), old, new, span)
            old, new = new, old
            if columns.width - j >= span:
                for rows in _again(old, n, span):
                    yield j, rows


def _collection(parts, span: int, gram: int):
    """Batches (doc, s, e) of the repeated strings of one collection, given as (doc, at, left, fragments) in order of precedence."""
    before = span - gram

    def out(found):
        rows, j = (np.concatenate(x) for x in zip(*found, strict=True))
        made = _merged(ids[rows], at[rows] - before + j, at[rows] - before + j + span)
        return pa.RecordBatch.from_arrays([*map(pa.array, made)], ["doc", "s", "e"])

    with tempfile.TemporaryFile(buffering=0) as file:
        columns, ids, at = Columns(file, 2 * span - gram), [], []
        for part in parts:
            raw, off = common.utf8(common.column(part, "frag"))
            columns.add(raw, off, before - common.column(part, "left").to_numpy().astype(np.int64))
            ids.append(common.column(part, "doc").to_numpy())
            at.append(common.column(part, "at").to_numpy())
        ids, at = np.concatenate(ids), np.concatenate(at)
        found, n = [], 0
        for j, rows in column_order(columns, span):
            if len(rows):
                found.append((rows, np.full(len(rows), j)))
                n += len(rows)
            if n >= FOUND:
                yield out(found)
                found, n = [], 0
        if found:
            yield out(found)


def _ordered(frags: DataFrame, span: int, gram: int) -> DataFrame:
    """(doc, s, e) of repeated strings of fragments (h, side, doc, at, left, frag); all fragments of one side that a task has are one collection.

    Strings that are equal and start in one column hold the same anchor in the same place, so that no other anchor's fragments disturb them.
    A side says how anchors grew; on two sides the same place of a text could stand in one column twice.
    """

    def run(batches):
        def parts():
            for batch in batches:
                side = common.column(batch, "side").to_numpy()
                edges = np.flatnonzero(np.diff(side)) + 1
                for a, b in zip([0, *edges], [*edges, len(side)], strict=True):
                    for part in common.slices(batch.slice(a, b - a), "frag"):
                        yield int(side[a]), part

        for _, group in itertools.groupby(parts(), key=lambda x: x[0]):
            yield from _collection((part for _, part in group), span, gram)

    n = common.partitions(frags.sparkSession)
    return frags.repartition(n, "h").sortWithinPartitions("side", "h", "doc", "at").mapInArrow(run, "doc bigint, s bigint, e bigint")


def _halves(frags: DataFrame, span: int, gram: int) -> tuple[DataFrame, int]:
    """The fragments once more under longer anchors, and the length of these: half the bytes that a string has beside its anchor join it.

    Of the span - gram bytes beside an anchor every string has half or more on its left or on its right. Fragments go, without what only
    other strings cover, to the collection of the bytes that stand there on the left, and to that of those on the right.
    """
    rest = span - gram
    half = -(-rest // 2)
    cut = lambda start, n: F.expr(f"substring(frag, {start} + 1, {n})")
    left = F.struct(
        F.xxhash64("h", "side", F.lit(0), cut(f"left - {half}", half)).alias("h"), (F.col("side") * 2).alias("side"), "doc", (F.col("at") - half).alias("at"), (F.col("left") - half).cast("int").alias("left"), cut("0", f"left - {half} + {span}").alias("frag")
    )
    keep = f"greatest(left - {rest - half}, 0)"
    right = F.struct(
        F.xxhash64("h", "side", F.lit(1), cut(f"left + {gram}", half)).alias("h"), (F.col("side") * 2 + 1).alias("side"), "doc", "at", F.least("left", F.lit(rest - half)).cast("int").alias("left"), cut(keep, "length(frag)").alias("frag")
    )
    both = F.array(F.when(F.col("left") >= half, left), F.when(F.expr(f"length(frag) >= left + {gram + half}"), right))
    made = frags.select(F.explode(F.array_compact(both)).alias("x")).select("x.*")
    return made.filter(F.length("frag") >= span), gram + half


def _first_of_each(frags: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The first of the fragments of one anchor that are equal byte by byte, and (doc, s, e) of the others, which are repeated throughout."""
    same = ["h", "side", "left", "frag"]
    lead = frags.groupBy(*same).agg(F.min(F.struct("doc", "at")).alias("lead"))
    first = lead.select("h", "side", "lead.doc", "lead.at", "left", "frag")
    begin = F.col("at") - F.col("left")
    other = frags.join(lead.repartition(common.partitions(frags.sparkSession)), same).filter((F.col("doc") != F.col("lead.doc")) | (F.col("at") != F.col("lead.at")))
    return first, other.select("doc", begin.alias("s"), (begin + F.length("frag")).alias("e"))


def _hot(rows: DataFrame) -> DataFrame:
    return common.materialize(rows.groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") > FRAGMENTS).select("h"), "hot")


def _parted(frags: DataFrame, hot: DataFrame, span: int, gram: int) -> DataFrame:
    """(doc, s, e) of repeated strings of fragments; the hot anchors, of over FRAGMENTS fragments, are parted by longer anchors until none has more."""
    out = None
    while True:
        none = gram == span or hot.isEmpty()
        frags = frags if none else common.materialize(frags, "fragments")
        found = _ordered(frags if none else frags.join(hot, "h", "left_anti").select(*frags.columns), span, gram)
        out = found if out is None else out.unionAll(found)
        if none:
            return out
        made, gram = _halves(frags.join(hot, "h", "left_semi").select(*frags.columns), span, gram)
        first, other = _first_of_each(common.materialize(made, "fragments"))
        frags = common.materialize(first, "fragments")
        out, hot = out.unionAll(other), _hot(frags)


def intervals(docs: DataFrame, span: int = SPAN, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """(doc, t) dealt by doc, and (doc, s, e): the repeated bytes of each document as intervals, which can overlap."""
    spark = docs.sparkSession
    n = common.partitions(spark)
    rows = _found(docs, span, gram).repartition(n, F.coalesce("h", "doc")).sortWithinPartitions("h", "c", "doc", "at")
    matched = common.materialize(_matched(rows), "anchors")
    want = matched.filter("kind = 1").select("h", "doc", "at", "lr")
    dealt = docs.repartition(n, "doc")
    frags = _cut(dealt.join(want.groupBy("doc").agg(F.collect_list(F.struct("h", "at", "lr")).alias("want")).hint("shuffle_hash"), "doc").select("doc", "t", "want"))
    found = matched.filter("kind = 0").select("doc", F.col("at").alias("s"), (F.col("at") + F.col("lr")).alias("e"))
    return dealt, found.unionAll(_parted(frags.withColumn("side", F.lit(0)), _hot(want), span, gram))


def remove_repeats(docs: DataFrame, span: int = SPAN, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept): every text without the bytes that a `span`-byte string covers which also starts earlier.

    Earlier is a smaller id, or a smaller place in the same document; strings lie in one document and are
    judged on the input. Null texts count as empty; texts shorter than `span` stay whole. Ids are integers; rows
    with one id and the same text are the same document; rows with a null id stay whole and repeat nothing.
    An empty table stays empty; other columns are left out. `kept` is binary, as cuts can fall inside a character.
    """
    all_ = docs.select(F.col(id_col).cast("long").alias("doc"), common.text_of(text_col).alias("t"))
    named = all_.filter("doc is not null")
    dealt, found = intervals(named, span, gram)
    spans = found.groupBy("doc").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    joined = dealt.join(spans.hint("shuffle_hash"), "doc", "left").select("doc", "t", "spans")
    joined = joined.unionByName(all_.filter("doc is null").withColumn("spans", F.lit(None).cast("array<struct<s:bigint,e:bigint>>")))

    def run(batches):
        for batch in batches:
            for part in common.slices(batch, "t"):
                raw, off = common.utf8(common.column(part, "t"))
                data, rows = raw.tobytes(), []
                spans = common.column(part, "spans")
                counts = np.nan_to_num(spans.value_lengths().to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
                flat = spans.flatten()
                s, e = (flat.field(x).to_numpy(zero_copy_only=False) for x in ("s", "e"))
                at = 0
                for i, c in enumerate(counts.tolist()):
                    a, b = off[i], off[i + 1]
                    text, removed, runs = data[a:b], 0, 0
                    if c:
                        _, x, y = _merged(np.zeros(c, np.int64), s[at : at + c], np.minimum(e[at : at + c], b - a))
                        at += c
                        runs, removed = len(x), int((y - x).sum())
                        text = b"".join(text[p:q] for p, q in zip([0, *y.tolist()], [*x.tolist(), int(b - a)], strict=True))
                    rows.append((int(b - a), removed, runs, text))
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([common.column(part, "doc"), *(pa.array(list(x), pa.int64()) for x in cols[:3]), pa.array(list(cols[3]), pa.binary())], [id_col, "n_bytes", "n_removed", "n_spans", "kept"])

    return joined.mapInArrow(run, f"`{id_col}` bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
