"""The thin queries over the driver's tables, one for each training-data operator, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskloom.llm import chat, common, langid, licenses, media, mixing, neardup, packing, pii, substrings, topk


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.features(media.to_media(table(spark, sf_dir, "documents")))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents")).drop("redacted_text")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.search(vectors, vectors.filter("vec_id % 50 = 0"), 5)


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    return packing.pack(table(spark, sf_dir, "documents")).drop("ids")


def op6_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.clusters(table(spark, sf_dir, "documents"), words=2, percent=80).withColumnRenamed("id", "doc_id")


#: Production parameters of the mixture.
WEIGHTS = {"domain": {"web": 5, "books": 3, "forum": 2}, "language": {"en": 4, "de": 2, "fr": 2}, "source": {"src0": 3}}
SHARE, EPOCHS, SEED = 0.6, 2, 17


def levels() -> dict:
    return {"domain": mixing.domain_of(F.col("source")), "language": F.col("lang"), "source": F.col("source")}


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    mixed = mixing.mix(docs, levels(), WEIGHTS, SHARE, EPOCHS, SEED)
    return mixed.select("doc_id", "epoch", F.col("__d").alias("domain"), F.col("__l").alias("language"), F.col("__s").alias("leaf_source"), mixing.words_in(F.col("text")).alias("n_tokens"))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.train(docs))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "<|im_end|><|im_start|>assistant ok"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    back = chat.read_back(chat.format_chats(turns))
    said_all = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said_all, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_media, op2_pii, op3_topk, op4_repeats, op5_packing, op6_neardup, op7_mixing, op8_langid, op9_chat, op10_licenses)}


# --- SQL -----------------------------------------------------------------------------------------

_TOPK = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
QUALIFY rank <= 5
"""

_NEARDUP = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) >= 2 THEN list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) WHEN len(w) = 1 THEN w ELSE [] END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.c = e.a),
m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN m USING (doc_id)
"""


def _weight(column: str, weights: dict[str, int]) -> str:
    return "CASE " + " ".join(f"WHEN {column} = '{k}' THEN {v}" for k, v in weights.items()) + " ELSE 1 END"


def _shared(source: str, parent: str, name: str) -> str:
    order = f"PARTITION BY {parent} ORDER BY w = 0, cap / greatest(w, 1), {name} ROWS BETWEEN"
    return f"""
      SELECT *, CASE WHEN filled THEN cap ELSE least(cap, CASE WHEN left_w > 0 THEN ((budget - used) * w) // greatest(left_w, 1) ELSE 0 END) END AS given FROM (
        SELECT *, coalesce(sum(cap) FILTER (filled) OVER (PARTITION BY {parent}), 0) AS used, coalesce(sum(w) FILTER (NOT filled) OVER (PARTITION BY {parent}), 0) AS left_w FROM (
          SELECT *, cap * open_w <= (budget - before) * w AS filled FROM (
            SELECT *, sum(cap) OVER ({order} UNBOUNDED PRECEDING AND CURRENT ROW) - cap AS before, sum(w) OVER ({order} CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w FROM ({source}))))"""


def _mixing() -> str:
    number = "try_cast(nullif(regexp_extract(coalesce(source, ''), '([0-9]{1,9})$', 1), '') AS BIGINT)"
    rows = f"""SELECT doc_id, coalesce(CASE {number} % 3 WHEN 0 THEN 'web' WHEN 1 THEN 'books' WHEN 2 THEN 'forum' END, 'other') AS d, coalesce(lang, '') AS l, coalesce(source, '') AS s,
        CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS tok FROM documents"""
    w = WEIGHTS
    return f"""
WITH t AS ({rows}),
leaf AS (SELECT d, l, s, CAST(sum(tok) AS BIGINT) AS tokens, CAST(sum(tok) * {EPOCHS} AS BIGINT) AS cap, {_weight("s", w["source"])} AS w FROM t GROUP BY d, l, s),
dom AS ({_shared(f'SELECT d, sum(cap)::BIGINT AS cap, {_weight("d", w["domain"])} AS w, (SELECT CAST(floor(sum(tokens) * CAST({SHARE} AS DOUBLE)) AS BIGINT) FROM leaf) AS budget, 0 AS k FROM leaf GROUP BY d', "k", "d")}),
lan AS ({_shared(f'SELECT x.d, l, cap, {_weight("l", w["language"])} AS w, budget FROM (SELECT d, l, sum(cap)::BIGINT AS cap FROM leaf GROUP BY d, l) x JOIN (SELECT d, given::BIGINT AS budget FROM dom) y USING (d)', "d", "l")}),
lea AS ({_shared('SELECT leaf.*, budget FROM leaf JOIN (SELECT d, l, given::BIGINT AS budget FROM lan) y USING (d, l)', "d, l", "s")}),
p AS (SELECT d, l, s, CASE WHEN tokens > 0 THEN least(given // greatest(tokens, 1), {EPOCHS}) ELSE 0 END AS whole, given, tokens FROM lea),
q AS (SELECT *, CASE WHEN whole < {EPOCHS} THEN given - whole * tokens ELSE 0 END AS rest FROM p),
o AS (SELECT t.*, whole, rest, sum(tok) OVER (PARTITION BY d, l, s ORDER BY md5(concat_ws('|', '{SEED}', CAST(whole AS VARCHAR), CAST(doc_id AS VARCHAR))), tok ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM t JOIN q USING (d, l, s)),
x AS (SELECT doc_id, unnest(range(CAST(whole AS BIGINT))) AS epoch, d, l, s, tok FROM o UNION ALL SELECT doc_id, whole, d, l, s, tok FROM o WHERE rest > 0 AND upto <= rest)
SELECT doc_id, CAST(epoch AS INTEGER) AS epoch, d AS domain, l AS language, s AS leaf_source, tok AS n_tokens FROM x
"""


_CHAT = """
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'), (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')),
t AS (SELECT *, replace(replace(text, '&', '&amp;'), '<|', '&lt;|') AS esc, replace(replace(replace(role, '&', '&amp;'), '<|', '&lt;|'), chr(10), '&nl;') AS head,
      coalesce(lag(role) OVER o = role, false) AS same FROM c WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS whole,
      coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
      sum(length(esc) + CASE WHEN same THEN length('<|im_sep|>') ELSE length('<|im_start|>') + length(head) + 1 + length('<|im_end|>') + 1 END) AS n FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(n AS BIGINT) AS formatted_chars FROM g
"""


def _licenses() -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    split = licenses.SPLIT.replace("\n", "\\n").replace("\t", "\\t").replace("\r", "\\r")
    stem = lambda x: "(" + " OR ".join(f"contains(lower({x}), {quote(s)})" for s in licenses.STEMS) + ")"
    table = ", ".join(f"({quote(k)}, {quote(v)})" for k, v in licenses.known().items())
    steps, found = [], []
    for i, (name, rule) in enumerate(licenses.RULES):
        steps.append(f"r{i + 1} AS (SELECT *, replace(s{i}, {quote(licenses.sequence_of(rule))}, '#') AS s{i + 1} FROM r{i})")
        found.append(f"CASE WHEN s{i} <> s{i + 1} THEN {quote(name)} END")
    n = len(licenses.RULES)
    first = {}
    for i, (name, _) in enumerate(licenses.RULES):
        first.setdefault(name, []).append(i)
    listed = "list_filter([" + ", ".join(found) + "], lambda x: x IS NOT NULL)"
    return f"""
WITH known(sentence, name) AS (VALUES {table}),
p AS (SELECT doc_id, unnest(string_split_regex(text, '{split}')) AS s, generate_subscripts(string_split_regex(text, '{split}'), 1) AS i FROM documents WHERE text IS NOT NULL),
k AS (SELECT doc_id, i, name FROM (SELECT * FROM p WHERE {stem("s")}) LEFT JOIN known ON sentence = trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g'))),
g AS (SELECT doc_id, count(name) AS n_known, count(*) - count(name) AS n_unknown, coalesce(string_agg(name, ',' ORDER BY i) FILTER (name IS NOT NULL), '') AS sentence_ids,
      coalesce(string_agg('|' || name || '|', '' ORDER BY i) FILTER (name IS NOT NULL), '') AS s0 FROM k GROUP BY doc_id),
r0 AS (SELECT * FROM g), {", ".join(steps)},
f AS (SELECT doc_id, n_known, n_unknown, sentence_ids, {listed} AS names FROM r{n})
SELECT d.doc_id, coalesce(n_known, 0) AS n_known, coalesce(n_unknown, 0) AS n_unknown, coalesce(sentence_ids, '') AS sentence_ids,
       coalesce(array_to_string(list_filter(names, lambda x, i: list_position(names, x) = i), ','), '') AS licenses
FROM documents d LEFT JOIN f USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_topk": _TOPK, "op6_neardup": _NEARDUP, "op7_mixing": _mixing(), "op9_chat": _CHAT, "op10_licenses": _licenses()}
