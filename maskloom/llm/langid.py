"""Language identification by blended-spectrum string kernels, Nyström landmarks and one-versus-rest kernel ridge regression."""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskloom.llm import common

ORDERS = (1, 2, 3)
UNKNOWN = "und"
#: Bounds of the learning sample: rows for each language, bytes of a text in it, and kernel landmarks for each language.
SAMPLE, SAMPLE_BYTES, LANDMARKS = 300, 20_000, 32
RIDGE = 1e-2


def gram_codes(raw: np.ndarray, off: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all byte n-grams that lie in one row, and their rows."""
    n = len(raw) - order + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = raw[:n].astype(np.int32)
    for i in range(1, order):
        code = (code << 8) | raw[i : i + n]
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))[:n]
    inside = np.arange(n) + order <= off[1:][row]
    return (code, row) if inside.all() else (code[inside], row[inside])


@dataclass
class Model:
    """Presence vocabulary, landmark presence, and the weights of the languages on the Nyström features."""

    languages: list[str]
    vocabulary: list[np.ndarray]  # for each order, sorted codes
    landmarks: np.ndarray  # landmarks x grams, rows scaled as the kernel scales them
    weights: np.ndarray  # landmarks x languages
    bias: np.ndarray

    def tables(self) -> list[np.ndarray]:
        """For each order the column of every code, and a spare last column for codes outside the vocabulary."""
        out, at, spare = [], 0, self.landmarks.shape[1]
        for order, codes in zip(ORDERS, self.vocabulary, strict=True):
            t = np.full(256**order, spare, np.uint16 if spare < 1 << 16 else np.int32)
            t[codes] = at + np.arange(len(codes))
            at += len(codes)
            out.append(t)
        return out


def presence(raw: np.ndarray, off: np.ndarray, tables: list[np.ndarray], columns: int, orders_at: list[int]) -> np.ndarray:
    """Rows of n-gram presence over the vocabulary; each order's part has length one (or is zero)."""
    out = np.zeros((len(off) - 1, columns + 1), np.float32)
    for a, b in common.blocks(off):
        for order, table in zip(ORDERS, tables, strict=True):
            code, row = gram_codes(raw[off[a] : off[b]], off[a : b + 1] - off[a], order)
            out[a + row, table[code]] = 1
    out = out[:, :columns]
    for a, b in zip(orders_at[:-1], orders_at[1:], strict=True):
        part = out[:, a:b]
        part /= np.sqrt(np.maximum(part.sum(1, keepdims=True), 1))
    return out / np.float32(np.sqrt(len(ORDERS)))


def fit(rows: list[tuple[str, str]], landmarks: int = LANDMARKS, ridge: float = RIDGE, least: int = 2) -> Model:
    """Learns from (text, language) rows. Landmarks are the first rows of each language; a gram is in the vocabulary if `least` rows have it."""
    languages = sorted({lang for _, lang in rows})
    raws = [t.encode() for t, _ in rows]
    off = np.concatenate([[0], np.cumsum([len(r) for r in raws])]).astype(np.int64)
    raw = np.frombuffer(b"".join(raws), np.uint8)
    vocabulary = []
    for order in ORDERS:
        own = []  # the distinct codes of each row
        for a, b in common.blocks(off):
            code, row = gram_codes(raw[off[a] : off[b]], off[a : b + 1] - off[a], order)
            own.append((np.unique(code.astype(np.int64) << 32 | row) >> 32).astype(np.int32))
        codes, counts = np.unique(np.concatenate(own), return_counts=True)
        vocabulary.append(codes[counts >= min(least, len(rows))])
    at = np.concatenate([[0], np.cumsum([len(v) for v in vocabulary])]).tolist()
    model = Model(languages, vocabulary, np.zeros((0, at[-1]), np.float32), np.zeros((0, 0)), np.zeros(0))
    x = presence(raw, off, model.tables(), at[-1], at)
    lang = np.array([languages.index(k) for _, k in rows])
    picked = np.concatenate([np.flatnonzero(lang == k)[:landmarks] for k in range(len(languages))])
    model.landmarks = x[picked]
    values, vectors = np.linalg.eigh((model.landmarks @ model.landmarks.T).astype(np.float64))
    kept = values > 1e-8 * values.max()
    root = vectors[:, kept] / np.sqrt(values[kept])
    phi = (x @ model.landmarks.T).astype(np.float64) @ root
    target = (lang[:, None] == np.arange(len(languages))).astype(float)
    even = 1 / np.bincount(lang)[lang]  # languages weigh alike, however many rows they have
    even /= even.sum()
    mean_x, mean_y = even @ phi, even @ target
    centred = phi - mean_x
    gram = (centred * even[:, None]).T @ centred
    w = np.linalg.solve(gram + ridge * np.eye(len(gram)) * np.trace(gram) / len(gram), (centred * even[:, None]).T @ (target - mean_y))
    model.weights, model.bias = root @ w, mean_y - mean_x @ w
    return model


def has_letter(text: str) -> bool:
    """Whether a text holds a letter (Unicode's categories L*): numbers such as a half or a Roman four are none."""
    return any(map(str.isalpha, text))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that learning never sees: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = SAMPLE) -> DataFrame:
    """(lang, text, r): at most `most` labelled rows of each language, numbered in it, chosen by a hash of the id, from rows that are not held out.

    A first count gives each language a hash bound that leaves a few times `most` rows, so that no window holds a language whole.
    """
    good = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(id_col) & (F.octet_length(text_col) <= SAMPLE_BYTES) & F.col(text_col).rlike(r"\p{L}"))
    at = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(11)), F.lit(1 << 30))
    keyed = good.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), at.alias("at"))
    counts = common.materialize(keyed.groupBy("lang").agg(F.count("*").alias("n")), "languages")  # of known size, so that Spark sends it while it is small
    near = keyed.join(counts, "lang").filter(F.col("at") * F.col("n") < F.lit(4 * most << 30).cast("double"))
    first = Window.partitionBy("lang").orderBy("at", "text")
    return near.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= most).select("lang", "text", "r")


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns (the id, or those named), held_out, lang_pred and score of every whole text.

    Texts that are null or have no letter are `und` with score 0, as are all where nothing could be learned.
    Scores are the winning regression, bounded to 0 and 1; ties go to the language first by name.
    Repeated rows repeat; an empty table stays empty.
    """
    keep = keep or [id_col]
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = sent.value
        if model is not None:
            tables, columns = model.tables(), model.landmarks.shape[1]
            at = np.concatenate([[0], np.cumsum([len(v) for v in model.vocabulary])]).tolist()
            land, weights = np.ascontiguousarray(model.landmarks.T), model.weights
        for batch in batches:
            for large in common.slices(batch, "__t"):
                for a in range(0, large.num_rows, 256):
                    part = large.slice(a, 256)
                    texts = common.column(part, "__t")
                    known = np.array([has_letter(t.as_py() or "") for t in texts]) & (model is not None)
                    names, scores = np.full(part.num_rows, UNKNOWN, object), np.zeros(part.num_rows)
                    if known.any():
                        raw, off = common.utf8(texts)
                        kernel = presence(raw, off, tables, columns, at) @ land
                        f = kernel.astype(np.float64) @ weights + model.bias
                        best = f.argmax(1)
                        names[known] = np.array(model.languages, object)[best[known]]
                        scores[known] = np.clip(f[np.arange(len(f)), best], 0, 1)[known]
                    rest = [common.column(part, f"__k{i}") for i in range(len(keep))]
                    yield pa.RecordBatch.from_arrays([*rest, common.column(part, "__h"), pa.array(names.tolist(), pa.string()), pa.array(scores)], [*[f"__k{i}" for i in range(len(keep))], "__h", "__p", "__s"])

    from pyspark.sql import types as T

    schema = T.StructType([T.StructField(f"__k{i}", docs.schema[c].dataType) for i, c in enumerate(keep)] + [T.StructField("__h", T.BooleanType()), T.StructField("__p", T.StringType()), T.StructField("__s", T.DoubleType())])
    chosen = [F.col(c).alias(f"__k{i}") for i, c in enumerate(keep)]
    made = docs.select(*chosen, held_out(id_col).alias("__h"), F.col(text_col).cast("string").alias("__t")).mapInArrow(common.released(run), schema)
    return made.select(*[F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)], F.col("__h").alias("held_out"), F.col("__p").alias("lang_pred"), F.col("__s").alias("score"))


def train(docs: DataFrame, **names) -> Model | None:
    """The model of the bounded sample, learned in one task, so that the driver gets the model alone; None if there is no labelled row."""

    def run(batches):
        rows = [(r["lang"], r["r"], r["text"]) for batch in batches for r in batch.to_pylist()]
        if rows:
            model = fit([(text, lang) for lang, _, text in sorted(rows)])
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model, pickle.HIGHEST_PROTOCOL)], pa.binary())], ["model"])

    made = sample(docs, **names).repartition(1).mapInArrow(common.released(run), "model binary").collect()
    return pickle.loads(made[0].model) if made else None


def accepted(docs: DataFrame, least: float = 0.2) -> DataFrame:
    """The table without the rows whose language can't be told: no letter, or a score below `least`. All columns stay."""
    model = train(docs)
    return predict(docs, model, keep=docs.columns).filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select(*docs.columns)
