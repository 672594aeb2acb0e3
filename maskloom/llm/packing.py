"""Packing by concatenation and cutting: token totals of partitions give global offsets, windows of fixed size cut them."""

from __future__ import annotations

import array
import functools
import gc
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskloom.llm import common

END_ID = 1
#: Units between white space whose ids a worker keeps; the store is emptied when it is full.
KEPT = 200_000
#: Bytes of text that are encoded at once, of texts that go through the tokenizer as a whole at once, and of ids that are cut at once.
ENCODED, WHOLE, CUT = 2 << 20, 1 << 18, 1 << 20

# How the word vocabulary splits lower-cased text, for characters up to U+017F, and the letters of its bytes.
_L = "a-zªµºß-öø-ſ"
_N = "0-9²³¹¼-¾"
_PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{_L}{_N}]+")
_PLAIN = re.compile(r"[\x00-\x1b\x20-¿À-įĲ-ľŁ-ňŊ-ž]*")
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_HIDDEN = {x: 256 + i for i, x in enumerate(sorted(set(range(256)).difference(_SHOWN)))}


def word_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@functools.lru_cache(maxsize=1)
def encoder(path: str) -> WordEncoder:
    """The encoder of this process, which keeps what it learned from task to task."""
    return WordEncoder(path)


class WordEncoder:
    """Ids of whole texts under a word vocabulary.

    The vocabulary parts text at white space and treats every piece alone, so units between white space are
    encoded once: Arrow splits a batch and numbers its units, and the units' ids are gathered by number. Texts
    with characters beyond U+017F, or with a special token's string, go through the tokenizer as a whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        self.ends: dict[str, bytes] = {}

    def _unit(self, unit: str) -> bytes:
        """Ids of a lower-cased unit without white space."""
        if unit.isalpha() and "ª" not in unit and "º" not in unit:
            return self._piece(unit)
        core = unit.rstrip(".,;:!?")
        if core and core != unit:
            end = unit[len(core) :]
            start = self.known.get(core)
            if start is None:
                start = self.known[core] = self._unit(core)
            return start + (self.ends.get(end) or self.ends.setdefault(end, self._piece(end)))
        return b"".join(map(self._piece, _PIECE.findall(unit)))

    def _piece(self, piece: str) -> bytes:
        if not piece.isascii():
            piece = piece.encode().decode("latin-1").translate(_HIDDEN)
        elif not piece.isalnum():
            piece = piece.translate(_HIDDEN)
        return array.array("I", [t.id for t in self.tokenizer.model.tokenize(piece)]).tobytes()

    def _units(self, texts: list[str]) -> list[np.ndarray]:
        lists = pc.utf8_split_whitespace(pc.utf8_lower(pa.array(texts, pa.large_string())))
        coded = lists.flatten().dictionary_encode()
        units, known = coded.dictionary.to_pylist(), self.known
        each = list(map(known.get, units))
        for i, x in enumerate(each):
            if x is None:
                if len(known) >= KEPT - 1:  # a unit and its core
                    known.clear()
                    self.ends.clear()
                each[i] = known[units[i]] = self._unit(units[i])
        each.append(np.uint32(END_ID).tobytes())
        sizes = np.fromiter(map(len, each), np.int64, len(each)) // 4
        ids, starts = np.frombuffer(b"".join(each), np.uint32), np.cumsum(sizes) - sizes
        ends = lists.offsets.to_numpy()[1:] - lists.offsets[0].as_py()
        unit = np.insert(coded.indices.to_numpy().astype(np.int64), ends, len(units))
        n = sizes[unit]
        upto = np.cumsum(n)
        flat = ids[np.repeat(starts[unit] - (upto - n), n) + np.arange(upto[-1])]
        return np.split(flat, upto[ends + np.arange(len(ends))][:-1])

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, without special tokens, and END_ID."""
        out: list = [None] * len(texts)
        plain, whole = [], []
        for i, t in enumerate(texts):
            (plain if _PLAIN.fullmatch(t) and not ("<|" in t and any(s in t for s in self.special)) else whole).append(i)
        if plain:
            collects = gc.isenabled()
            gc.disable()  # millions of small values that refer to nothing
            try:
                for i, ids in zip(plain, self._units([texts[i] for i in plain]), strict=True):
                    out[i] = ids
            finally:
                if collects:
                    gc.enable()
        for some in common.slices(pa.record_batch([pa.array(whole, pa.int64()), pa.array([texts[i] for i in whole], pa.large_string())], ["i", "t"]), "t", WHOLE):
            for i, e in zip(common.column(some, "i").to_pylist(), self.tokenizer.encode_batch(common.column(some, "t").to_pylist(), add_special_tokens=False), strict=True):
                out[i] = np.array([*e.ids, END_ID], np.uint32)
        return out


def tokenized(docs: DataFrame, path: str, id_col: str, text_col: str) -> DataFrame:
    """First pass: (part, before, id, n, ids), where `before` counts the partition's tokens before the document."""

    def run(batches):
        encode, part, before = encoder(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            for piece in common.slices(batch, "t", ENCODED):
                ids = encode(common.column(piece, "t").to_pylist())
                n = np.array([len(x) for x in ids], np.int64)
                starts = before + np.cumsum(n) - n
                before += int(n.sum())
                # ids below 2**16 are stored in two bytes
                small = [(x.astype("<u2") if x.max() < 65536 else x.astype("<u4")).tobytes() for x in ids]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part), pa.int32()), pa.array(starts), common.column(piece, id_col), pa.array(n), pa.array(small, pa.binary())], ["part", "before", id_col, "n", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), common.text_of(text_col).alias("t")).mapInArrow(common.released(run), f"part int, before bigint, `{id_col}` {kind}, n bigint, ids binary")


def pack(docs: DataFrame, size: int = 2048, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces (id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids) of all documents in sequences of `size` tokens.

    Documents stand end to end in the order of the input's partitions, each with END_ID at its end;
    sequence s holds tokens s * size to (s + 1) * size. Every boundary inside a document makes a
    record of its own for each side; only the last sequence can be short. Null texts count as empty and have one
    token; repeated rows are packed each; an empty table gives no pieces; other columns are left out.

    The tokens of the first pass are a table in the shared folder, so that order and offsets stay
    as they are whatever is computed again. The totals are one row a partition.
    """
    tokens = common.materialize(tokenized(docs, path or word_path(), id_col, text_col), "tokens")
    totals = tokens.groupBy("part").agg(F.sum("n").alias("total"))
    base = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("base"))
    base = common.materialize(base, "offsets")  # of known size, so that Spark sends it rather than shuffle the tokens while it is small
    placed = tokens.join(base, "part").select(id_col, (F.col("base") + F.col("before")).alias("at"), "n", "ids")

    def run(batches):
        for batch in batches:
            for part in common.slices(batch, "ids", CUT):
                raw, off = common.utf8(common.column(part, "ids"))
                at, n = (common.column(part, c).to_numpy() for c in ("at", "n"))
                count = (at + n - 1) // size - at // size + 1
                row = np.repeat(np.arange(len(n)), count)
                k = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                first = at[row] // size + k
                start = np.maximum(first * size, at[row]) - at[row]
                length = np.minimum((first + 1) * size, at[row] + n[row]) - at[row] - start
                wide = np.diff(off) // n
                ids = []
                for r, s, c in zip(row, start, length, strict=True):
                    w = wide[r]
                    a = off[r] + s * w
                    ids.append(raw[a : a + c * w].view("<u2" if w == 2 else "<u4").astype("<u4").tobytes())
                crc = pa.array([zlib.crc32(x) for x in ids], pa.int64())
                made = [pa.array(start), pa.array(length), crc, pa.array(n[row]), pa.array(first), pa.array(at[row] + start - first * size), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays([common.column(part, id_col).take(pa.array(row)), *made], [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return placed.mapInArrow(common.released(run), f"`{id_col}` {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary")


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, ids): the packed sequences themselves, as little-endian 32-bit ids. A sequence has at most `size` pieces."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(ordered, F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    return pieces.groupBy("sequence_id").agg(joined.alias("ids"))
