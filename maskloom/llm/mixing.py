"""Mixing sources to target weights over a tree of domains, languages and sources, with DataFrame functions only.

A budget of tokens goes down the tree. At each node the children share it by weight; what a child can't use (its
tokens times the epochs allowed) goes to its siblings by their weights, and only what all children
together can't use goes back to the node's own siblings. A leaf takes whole epochs of its rows and then a
prefix of one more epoch, in an order of its own that a seed and the epoch give.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskloom.llm import common

#: Rows of a leaf's epoch that one bucket of its order holds, about; only one bucket of a leaf is ever sorted.
BUCKET_ROWS = 4096
LEVELS = ("__d", "__l", "__s")
#: Names of the operator's own columns beside those that it returns.
INSIDE = frozenset(f"__{c}" for c in ("id", "tok", "whole", "rest", "buckets", "cut", "before", "bucket", "epoch", "key", "upto"))


def words_in(text: Column) -> Column:
    """Tokens of a text: its words between white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def domain_of(source: Column, names: tuple[str, ...] = ("web", "books", "forum")) -> Column:
    """The domain of a source by the number that its name ends with; `other` where it has none."""
    number = F.try_to_number(F.nullif(F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9]{1,9})$", 1), F.lit("")), F.lit("999999999"))
    out = F.when(number.isNull(), F.lit("other"))
    for i, name in enumerate(names):
        out = out.when(F.pmod(number.cast("long"), F.lit(len(names))) == i, F.lit(name))
    return out


def weight_of(value: Column, weights: dict[str, int]) -> Column:
    """The whole-number weight of a node's name; 1 where none is given."""
    out = None
    for name, w in weights.items():
        out = F.when(value == name, F.lit(w)) if out is None else out.when(value == name, F.lit(w))
    return (out.otherwise(F.lit(1)) if out is not None else F.lit(1)).cast("long")


def shared_out(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Adds `given`: the parent's `budget` shared by `weight` w, no child above its `capacity`, shortages redistributed.

    In the order of capacity by weight, children whose fair share of what is left reaches their capacity are filled;
    the others share the rest by weight, rounded down.
    """
    by = [F.col("weight") == 0, F.col("capacity") / F.greatest("weight", F.lit(1)), F.col(name)]
    w = Window.partitionBy(*parent).orderBy(*by)
    upto, after = w.rowsBetween(Window.unboundedPreceding, Window.currentRow), w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    c = children.withColumn("before", F.sum("capacity").over(upto) - F.col("capacity")).withColumn("open", F.sum("weight").over(after))
    c = c.withColumn("full", F.col("capacity") * F.col("open") <= (F.col("budget") - F.col("before")) * F.col("weight"))
    whole = Window.partitionBy(*parent)
    c = c.withColumn("used", F.coalesce(F.sum(F.when(F.col("full"), F.col("capacity"))).over(whole), F.lit(0)))
    c = c.withColumn("open", F.coalesce(F.sum(F.when(~F.col("full"), F.col("weight"))).over(whole), F.lit(0)))
    share = F.when(F.col("open") > 0, F.expr("((budget - used) * weight) div greatest(open, 1)")).otherwise(0)
    return c.withColumn("given", F.when(F.col("full"), F.col("capacity")).otherwise(F.least("capacity", share))).drop("before", "open", "full", "used")


def order_key(row_id: Column, epoch: Column, seed: int) -> Column:
    """A row's place in an epoch: 32 hexadecimal digits."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(row_id.cast("string"), F.lit(""))))


def _head(key: Column) -> Column:
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("long")


def plan(docs: DataFrame, levels: dict[str, Column], weights: dict[str, dict[str, int]], tokens: Column, row_id: Column, share: float, epochs: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """The rows with their leaf, and the leaves: budget (`given`), whole epochs, rest, and where the order is cut.

    A leaf is one row, so that joining it needs no window over a leaf's rows.
    """
    names = [F.coalesce(v.cast("string"), F.lit("")).alias(k) for k, v in zip(LEVELS, levels.values(), strict=True)]
    narrow = common.materialize(docs.select(*names, tokens.alias("__tok"), row_id.cast("string").alias("__id")), "lengths")
    leaf = narrow.groupBy(*LEVELS).agg(F.sum("__tok").alias("tokens"), F.count("*").alias("rows"))
    tables = [weights.get(k, {}) for k in levels]
    d, lang, s = LEVELS
    leaf = leaf.withColumn("capacity", F.col("tokens") * epochs)
    langs = leaf.groupBy(d, lang).agg(F.sum("capacity").alias("capacity"))
    domains = leaf.groupBy(d).agg(F.sum("capacity").alias("capacity"))
    total = leaf.agg(F.floor(F.coalesce(F.sum("tokens"), F.lit(0)) * F.lit(share)).cast("long").alias("budget"))
    # one row of one number meets the few domains
    domains = domains.withColumn("weight", weight_of(F.col(d), tables[0])).withColumn("k", F.lit(0)).join(total.withColumn("k", F.lit(0)), "k")
    domains = shared_out(domains, ["k"], d).select(d, F.col("given").alias("budget"))
    langs = shared_out(langs.withColumn("weight", weight_of(F.col(lang), tables[1])).join(domains, d), [d], lang).select(d, lang, F.col("given").alias("budget"))
    leaf = shared_out(leaf.withColumn("weight", weight_of(F.col(s), tables[2])).join(langs, [d, lang]), [d, lang], s)
    leaf = leaf.withColumn("whole", F.when(F.col("tokens") > 0, F.expr("least(given div greatest(tokens, 1), %d)" % epochs)).otherwise(0).cast("int"))
    leaf = leaf.withColumn("rest", F.when(F.col("whole") < epochs, F.col("given") - F.col("whole") * F.col("tokens")).otherwise(F.lit(0)))
    leaf = leaf.withColumn("buckets", F.ceil(F.col("rows") / BUCKET_ROWS).cast("long"))
    leaf = common.materialize(leaf.select(*LEVELS, "tokens", "given", "whole", "rest", "buckets"), "leaves")
    placed = narrow.join(leaf, list(LEVELS)).withColumn("bucket", bucket_of(F.col("__id"), seed))
    sums = placed.groupBy(*LEVELS, "bucket").agg(F.sum("__tok").alias("n"), F.first("rest").alias("rest"))
    run = F.sum("n").over(Window.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    over = sums.withColumn("upto", run).filter(F.col("upto") > F.col("rest"))
    cut = over.groupBy(*LEVELS).agg(F.min(F.struct("bucket", (F.col("upto") - F.col("n")).alias("before"))).alias("cut"))
    cut = cut.select(*[F.col(c).alias(f"c{c}") for c in LEVELS], F.col("cut.bucket").alias("cut"), F.col("cut.before").alias("before"))
    same = [F.col(c) == F.col(f"c{c}") for c in LEVELS]
    leaf = common.materialize(leaf.join(cut, same, "left").drop(*[f"c{c}" for c in LEVELS]), "leaves")
    return docs.select("*", *names, row_id.cast("string").alias("__id")), leaf


def bucket_of(row_id: Column, seed: int, prefix: str = "") -> Column:
    """Bucket of a row in the order of its leaf's last epoch (`whole`); needs the leaf's columns beside it."""
    return F.shiftright(_head(order_key(row_id, F.col(f"{prefix}whole"), seed)) * F.col(f"{prefix}buckets"), 32)


def mix(docs: DataFrame, levels: dict[str, Column], weights: dict[str, dict[str, int]], share: float = 0.5, epochs: int = 2, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", tokens: Column | None = None) -> DataFrame:
    """The rows selected, with all their columns, `epoch` (from 0), and the leaf's names under __d, __l and __s.

    levels: three columns, from the root; weights: for each level whole-number weights by name, 1 where
    none is given, 0 for nothing. The budget is `share` of all tokens. A leaf's rows are taken once for each whole
    epoch, then those of the next epoch, in the order of its key, whose running token total stays within the rest.
    Null names are the empty name; null texts have no tokens and come with whole epochs or at a prefix's start; rows
    that repeat are taken each, ties in the order going by token count. Input columns `epoch`, __d, __l and __s give way to the
    operator's; others whose names the operator uses inside come back as they were. An empty table gives an empty table.
    """
    tokens = words_in(F.col(text_col)) if tokens is None else tokens
    docs = docs.drop(*LEVELS)
    aside = {c: f"{c}{'_' * len(''.join(docs.columns))}" for c in docs.columns if c in INSIDE}
    if aside:
        back = {v: k for k, v in aside.items()}
        return mix(docs.withColumnsRenamed(aside), levels, weights, share, epochs, seed, id_col, text_col, tokens).withColumnsRenamed(back)
    rows, leaf = plan(docs, levels, weights, tokens, F.col(id_col), share, epochs, seed)
    leaf = leaf.select(*LEVELS, *[F.col(c).alias(f"__{c}") for c in ("whole", "rest", "buckets", "cut", "before")])
    placed = rows.join(leaf, list(LEVELS)).withColumn("__bucket", bucket_of(F.col("__id"), seed, "__"))
    columns = [*[F.col(c) for c in docs.columns if c != "epoch"], *[F.col(c) for c in LEVELS]]
    take = F.when(F.col("__cut").isNull() | (F.col("__bucket") < F.col("__cut")), F.col("__whole")).otherwise(F.col("__whole") - 1)
    take = F.when(F.col("__rest") > 0, take).otherwise(F.col("__whole") - 1)
    whole = placed.withColumn("__epoch", F.explode(F.when(take >= 0, F.sequence(F.lit(0), F.greatest(take, F.lit(0)))))).select(*columns, F.col("__epoch").alias("epoch"))
    edge = placed.filter((F.col("__rest") > 0) & (F.col("__bucket") == F.col("__cut"))).withColumn("__tok", tokens).withColumn("__key", order_key(F.col("__id"), F.col("__whole"), seed))
    run = Window.partitionBy(*LEVELS).orderBy("__key", "__tok").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = edge.withColumn("__upto", F.col("__before") + F.sum("__tok").over(run)).filter(F.col("__upto") <= F.col("__rest"))
    return whole.unionByName(edge.select(*columns, F.col("__whole").alias("epoch")))
