"""Near-duplicates by a chosen-path set similarity join over minwise signatures.

Each of several independent trees starts with all sets in its root. A node picks one or two of the
signature's coordinates by a hash of its own name; a set goes to the child that its minwise token at a
picked coordinate names. Two sets of similarity s share a child with probability s for each pick, so
with 1.25 picks in the mean similar sets stay together while others part. All nodes have the same depth, as each level loses
similar pairs; the number of trees follows from it. Nodes compare their sets exhaustively by signature.

What the trees find is the candidate graph. Its connected groups are then confirmed on the full
shingle sets: inside a group every pair counts, except pairs that are already connected.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskloom.llm import common

COORDINATES = 128
#: The chance to miss a pair of just the similarity asked for, which sets the number of trees.
MISS = 1e-6
#: Sets of a node that are compared at once; larger nodes are compared chunk by chunk.
LEAF = 512
#: Signature agreement from which a pair is a candidate: 5 standard deviations below the similarity asked for.
MARGIN = 5.0
#: Rows and bytes of a group that one task confirms; larger groups are confirmed block by block.
GROUP_ROWS, GROUP_BYTES = 4096, 48 << 20


def sets_of(docs: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, print, sig, short): size, 128-bit fingerprint, minwise signature and its low bytes of each text's shingle set; null where it is empty."""

    def run(batches):
        for batch in batches:
            for part in common.slices(batch, "t"):
                raw, off = common.utf8(common.column(part, "t"))
                values, at = common.shingle_sets(raw, off, words)
                sig = common.minhashes(values, at, COORDINATES)
                n = np.diff(at)
                two = [np.zeros(len(n), np.uint64) for _ in range(2)]
                some = np.flatnonzero(n)
                if len(some):
                    for k, salt in enumerate((0x5851F42D4C957F2D, 0x14057B7EF767814F)):
                        two[k][some] = np.add.reduceat(common.mix(values ^ np.uint64(salt)), at[:-1][some])
                prints = np.stack(two, 1)
                ok = n > 0
                made = [pa.array(n), pa.array([p.tobytes() if k else None for p, k in zip(prints, ok, strict=True)], pa.binary()), *[pa.array([s.tobytes() if k else None for s, k in zip(x, ok, strict=True)], pa.binary()) for x in (sig, sig.astype(np.uint8))]]
                yield pa.RecordBatch.from_arrays([common.column(part, "id"), *made], ["id", "n", "print", "sig", "short"])

    return docs.select(F.col(id_col).cast("long").alias("id"), common.text_of(text_col).alias("t")).mapInArrow(common.released(run), "id bigint, n bigint, print binary, sig binary, short binary")


def _signatures(col, kind: type = np.uint32) -> np.ndarray:
    raw, _ = common.utf8(col)
    return raw.view(kind).reshape(-1, COORDINATES)


def _children(node: np.ndarray, sig: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level down: (child, row) for each pick of each node; a quarter of the nodes pick two coordinates."""
    h = common.mix(node * np.uint64(3) + np.uint64(1))
    first = (h >> np.uint64(8)) % np.uint64(COORDINATES)
    step = np.uint64(1) + (h >> np.uint64(24)) % np.uint64(COORDINATES - 1)
    two = (h >> np.uint64(48)) % np.uint64(4) == 0
    picks = [(np.arange(len(node)), first), (np.flatnonzero(two), ((first + step) % np.uint64(COORDINATES))[two])]
    out, rows = [], []
    for at, coordinate in picks:
        token = sig[row[at], coordinate.astype(np.int64)].astype(np.uint64)
        out.append(common.mix(node[at] ^ common.mix(coordinate << np.uint64(32) | token)))
        rows.append(row[at])
    return np.concatenate(out), np.concatenate(rows)


def _paths(reps: DataFrame, depth: int, trees: int) -> DataFrame:
    """(node, id): the nodes of every tree that a set reaches at `depth`."""

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                sig, ids = _signatures(common.column(part, "sig")), common.column(part, "id").to_numpy()
                nodes, rows = [], []
                for tree in range(trees):
                    node, row = common.mix(np.full(len(ids), tree + 1, np.uint64)), np.arange(len(ids))
                    for _ in range(depth):
                        node, row = _children(node, sig, row)
                    nodes.append(node)
                    rows.append(row)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(nodes).view(np.int64)), pa.array(ids[np.concatenate(rows)])], ["node", "id"])

    return reps.select("id", "sig").mapInArrow(common.released(run), "node bigint, id bigint")


def _groups_of(batches, key: str, bytes_col: str | None = None):
    """Whole runs of equal keys from sorted batches, some at a time: tables whose last run is complete."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = common.column(batch, key).to_numpy()
        cut = int(np.searchsorted(k, k[-1], side="left")) if (k[1:] >= k[:-1]).all() else int(np.flatnonzero(k != k[-1])[-1]) + 1
        if cut == 0 and held and common.column(held[-1], key)[0].as_py() == k[-1]:
            held.append(batch)
            continue
        if held and common.column(held[-1], key)[-1].as_py() != k[0]:
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks()
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _find(parent: np.ndarray, i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def _flat(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if (up == parent).all():
            return up
        parent = up


def _node_links(rows: DataFrame, threshold: float) -> DataFrame:
    """(a, b): a spanning forest of the pairs in each node of rows (node, id, short) whose signatures agree enough.

    Each tree's root is its smallest id, so that a family that many nodes hold gives mostly the same links in all of them. Low bytes agree wherever signatures do, so that comparing them loses no pair; false ones go when links are confirmed.
    """
    least = _agreement(threshold)

    def run(batches):
        for table in _groups_of(batches, "node"):
            node = table.column("node").to_numpy()
            ids = table.column("id").to_numpy()
            sig = _signatures(table.column("short").combine_chunks() if isinstance(table.column("short"), pa.ChunkedArray) else table.column("short"), np.uint8)
            edges = np.flatnonzero(np.diff(node, prepend=node[0] - 1, append=node[-1] + 1))
            out_a, out_b = [], []
            sizes = np.diff(edges)
            pairs = edges[:-1][sizes == 2]  # most nodes: both sets at once
            if len(pairs):
                near = ((sig[pairs] == sig[pairs + 1]).sum(1) >= least) & (ids[pairs] != ids[pairs + 1])
                out_a.append(ids[pairs[near] + 1])
                out_b.append(ids[pairs[near]])
            for a, n in zip(edges[:-1][sizes > 2], sizes[sizes > 2], strict=True):
                own, parent = sig[a : a + n], np.arange(n)
                left = np.ones(n, bool)
                stack = []
                # breadth-first over the agreement graph: each set meets those not reached so far
                for root in range(n):
                    if not left[root]:
                        continue
                    left[root] = False
                    stack = [root]
                    while stack and left.any():
                        x = stack.pop()
                        others = np.flatnonzero(left)
                        near = others[(own[others] == own[x]).sum(1) >= least]
                        left[near] = False
                        parent[near] = root
                        stack += near.tolist()
                moved = np.flatnonzero(parent != np.arange(n))
                out_a.append(ids[a + moved])
                out_b.append(ids[a + parent[moved]])
            if out_a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], ["a", "b"])

    n = common.partitions(rows.sparkSession)
    return rows.select("node", "id", "short").repartition(n, "node").sortWithinPartitions("node", "id").mapInArrow(common.released(run), "a bigint, b bigint")


def _agreement(threshold: float) -> int:
    """Equal coordinates from which a pair is a candidate."""
    return math.floor(COORDINATES * threshold - MARGIN * math.sqrt(COORDINATES * threshold * (1 - threshold)))


def missed(threshold: float, depth: int, trees: int) -> float:
    """The chance that no tree brings two sets of a similarity together at a depth, over all agreements that their signatures can have."""
    out = 0.0
    for k in range(COORDINATES + 1):
        s, apart = k / COORDINATES, 0.0
        for _ in range(depth):
            one = 1 - s + s * apart
            apart = 0.75 * one + 0.25 * one**2
        out += math.comb(COORDINATES, k) * threshold**k * (1 - threshold) ** (COORDINATES - k) * apart**trees
    return out


def trees_for(threshold: float, depth: int) -> int:
    """The least number of trees that holds MISS at a depth."""
    trees = 1
    while missed(threshold, depth, trees) > MISS:
        trees += 1
    return trees


def candidates(reps: DataFrame, threshold: float, trees: int | None = None) -> DataFrame:
    """(a, b): links of the candidate graph over sets (id, sig, short) that differ from each other."""
    count = reps.count()
    depth = max(2, math.ceil(math.log(max(count, 1) / 64) / math.log(24))) if count > 16 else 1
    rows = common.materialize(_paths(reps, depth, trees or trees_for(threshold, depth)), "paths")
    sizes = rows.groupBy("node").agg(F.count("*").alias("size"), F.min("id").alias("lead"), F.max("id").alias("last")).filter("lead < last")
    shared = common.materialize(rows.join(sizes, "node").select("node", "id", "size", "lead"), "nodes")
    common.drop_table(rows)
    small = shared.filter(F.col("size") <= LEAF).join(reps.select("id", "short"), "id")
    links = common.materialize(_node_links(small, threshold).distinct(), "links")
    large, scratch = shared.filter(F.col("size") > LEAF), [shared, links]
    if not large.isEmpty():
        large = common.materialize(large.join(reps.select("id", "short"), "id"), "large")
        more, used = _large_links(large, links, threshold)
        links, scratch = links.unionAll(more), [*scratch, large, *used]
    out = common.materialize(links.distinct(), "candidates")
    common.drop_table(*scratch)
    return out


def _large_links(large: DataFrame, links: DataFrame, threshold: float) -> tuple[DataFrame, list[DataFrame]]:
    """(a, b): links of large nodes, from rows (node, id, size, lead, short), in two steps of bounded tasks; and the scratch tables under them.

    First chunks of about LEAF sets meet the node's first set and themselves. What is then connected with the first set needs no more links
    among itself; the other sets, in chunks again, meet every chunk of the node, so that no pair that matters goes uncompared.
    """
    chunks = lambda n: F.ceil(F.col(n) / LEAF)
    all_ = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), chunks(n) - 1))
    large = large.withColumn("chunk", F.pmod(F.xxhash64("id", "node"), chunks("size")))
    leads = large.filter("id = lead").withColumn("chunk", all_("size"))
    own = large.filter("id <> lead").unionByName(leads).withColumn("node", F.xxhash64("node", "chunk"))
    first = common.materialize(_node_links(own, threshold).distinct(), "links")
    comp = common.materialize(common.components(links.unionAll(first), "large"), "large")
    to, of = comp.select(F.col("node").alias("id"), "comp"), comp.select(F.col("node").alias("lead"), F.col("comp").alias("lead_comp"))
    free = large.join(to, "id", "left").join(of, "lead", "left").filter(F.coalesce("comp", "id") != F.coalesce("lead_comp", "lead"))
    free = common.materialize(free.select(*large.columns), "free")
    counts = free.groupBy("node").agg(F.count("*").alias("n"))
    side = free.join(counts, "node").withColumn("p", F.pmod(F.xxhash64("node", "id"), chunks("n"))).withColumn("chunk", all_("size"))
    rest = large.join(counts, "node").withColumn("p", all_("n"))
    met = side.unionByName(rest).select(F.xxhash64("node", "p", "chunk").alias("node"), "id", "short").dropDuplicates(["node", "id"])
    second = common.materialize(_node_links(met, threshold).distinct(), "links")
    return first.unionAll(second), [first, comp, free, second]


def _linked(parent, sets, sig, order, others, percent: int, least: int) -> None:
    """Connects each set of `order` with sets of `others` of other components whose signatures agree enough, by exact comparison of full sets."""
    sizes = np.array([len(s) for s in sets])
    for i in order:
        roots = _flat(parent)
        rest = others[(roots[others] != roots[i]) & (others != i)]
        rest = rest[(100 * np.minimum(sizes[rest], sizes[i]) >= percent * np.maximum(sizes[rest], sizes[i]))]
        if not len(rest):
            continue
        agree = (sig[rest] == sig[i]).sum(1)
        rest, agree = rest[agree >= least], agree[agree >= least]
        for j in rest[np.argsort(-agree, kind="stable")]:
            a, b = _find(parent, i), _find(parent, j)
            if a != b:
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * both >= percent * (sizes[i] + sizes[j] - both):
                    parent[max(a, b)] = min(a, b)


def _confirmed(rows: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b): exact links, enough of them to connect what is connected in each group of rows (grp, side, id, t).

    side 0: pairs of all rows of the group; otherwise pairs of a row of side 1 and a row of side 2.
    """
    least = _agreement(percent / 100)

    def run(batches):
        for table in _groups_of(batches, "grp"):
            key = table.column("grp").to_numpy()
            edges = np.flatnonzero(np.diff(key, prepend=key[0] - 1, append=key[-1] + 1))
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                part = table.slice(a, b - a).sort_by("id").combine_chunks()
                ids, side = part.column("id").to_numpy(), part.column("side").to_numpy()
                raw, off = common.utf8(part.column("t").combine_chunks() if isinstance(part.column("t"), pa.ChunkedArray) else part.column("t"))
                values, at = common.shingle_sets(raw, off, words)
                sig = common.minhashes(values, at, COORDINATES)
                sets = [values[x:y] for x, y in zip(at[:-1], at[1:], strict=True)]
                parent = np.arange(len(ids))
                all_ = np.arange(len(ids))
                if (side == 0).all():
                    for i in range(len(ids)):
                        _linked(parent, sets, sig, [i], all_[i + 1 :], percent, least)
                else:
                    _linked(parent, sets, sig, all_[side == 1], all_[side == 2], percent, least)
                root = _flat(parent)
                moved = np.flatnonzero(root != all_)
                if len(moved):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[root[moved]])], ["a", "b"])

    n = common.partitions(rows.sparkSession)
    return rows.select("grp", "side", "id", "t").repartition(n, "grp").sortWithinPartitions("grp").mapInArrow(common.released(run), "a bigint, b bigint")


def clusters(docs: DataFrame, words: int = 5, percent: int = 80, trees: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept): near-duplicate groups of all texts.

    Texts are linked whose sets of `words`-word shingles share `percent` hundredths or more of their
    union; a group is what links connect, named by its smallest id, which is kept. Null texts and
    texts without words have no shingles and stand alone; equal sets are always linked. Ids are
    integers; a repeated id with the same text is one set; null ids stand alone, under a null group.
    An empty table gives an empty table; other columns are left out.
    """
    info = common.materialize(sets_of(docs, words, id_col, text_col), "sets")
    named = info.filter("n > 0 and id is not null")
    reps = common.materialize(named.groupBy("print").agg(F.min("id").alias("id"), F.min_by(F.struct("sig", "short"), "id").alias("s")).select("print", "id", "s.*"), "reps")
    links = candidates(reps, percent / 100, trees)
    groups = common.materialize(common.components(links, "groups"), "groups")
    near = groups.select(F.col("node").alias("id"), F.col("comp").alias("grp"))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), common.text_of(text_col).alias("t"))
    member = near.join(texts, "id").dropDuplicates(["id"])
    member = common.materialize(member.withColumn("bytes", F.octet_length("t")), "members")
    sizes = common.materialize(member.groupBy("grp").agg(F.count("*").alias("size"), F.sum("bytes").alias("bytes")), "sizes")
    large = sizes.filter((F.col("size") > GROUP_ROWS) | (F.col("bytes") > GROUP_BYTES))
    rows = member.join(large.select("grp"), "grp", "left_anti").select("grp", F.lit(0).alias("side"), "id", "t")
    exact = common.materialize(_confirmed(rows, words, percent), "exact")
    scratch = [links, groups, member, sizes, exact]
    if not large.isEmpty():
        more, used = _in_blocks(member, large, words, percent)
        exact, scratch = exact.unionAll(more), [*scratch, *used]
    joined = common.components(exact, "exact")
    common.drop_table(*scratch)
    final = reps.select("print", "id").join(joined.select(F.col("node").alias("id"), "comp"), "id", "left").select("print", F.coalesce("comp", "id").alias("comp"))
    out = info.select(F.col("id"), "n", "print").join(final, "print", "left").select("id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("comp", "id")).otherwise(F.col("id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))


def _in_blocks(member: DataFrame, large: DataFrame, words: int, percent: int) -> tuple[DataFrame, list[DataFrame]]:
    """Exact links of groups too large for one task, in two steps of bounded tasks; and the scratch tables under them.

    First every block of a group is confirmed by itself together with the group's first set, so that what
    is near that set is connected throughout. Then the blocks meet in pairs, but only sets that are not connected
    with the first set meet all the others.
    """
    blocks = large.select("grp", F.greatest(F.ceil(F.col("size") / (GROUP_ROWS // 2)), F.ceil(F.col("bytes") / (GROUP_BYTES // 2))).cast("int").alias("blocks"))
    rows = member.join(blocks, "grp").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rows = dealt = common.materialize(rows, "blocks")
    lead = rows.filter("id = grp").select("grp", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "id", "t")
    own = rows.filter("id <> grp").select("grp", "block", "id", "t").unionByName(lead)
    first = common.materialize(_confirmed(own.select(F.xxhash64("grp", "block").alias("grp"), F.lit(0).alias("side"), "id", "t"), words, percent), "exact")
    comp = common.materialize(common.components(first, "exact"), "exact")
    rows = rows.join(comp.select(F.col("node").alias("id"), "comp"), "id", "left").withColumn("free", F.coalesce("comp", "id") != F.col("grp"))
    rows = common.materialize(rows.select("grp", "blocks", "block", "free", "id", "t"), "blocks")
    free = rows.filter("free").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(F.xxhash64("grp", "block", "other").alias("k"), F.lit(1).alias("side"), "id", "t")
    used = rows.filter("free").select("grp", F.col("block").alias("from")).distinct()
    rest = rows.join(used, "grp").select(F.xxhash64("grp", "from", "block").alias("k"), F.lit(2).alias("side"), "id", "t")
    met = free.unionByName(rest).withColumnRenamed("k", "grp")
    second = common.materialize(_confirmed(met, words, percent), "exact")
    return first.unionAll(second), [dealt, first, comp, rows, second]


def keep_first(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The table with one row of each near-duplicate group: that of the smallest id. All columns stay; null ids stay."""
    groups = clusters(docs, words, percent, id_col=id_col, text_col=text_col)
    gone = groups.filter("not kept").select(F.col("id").alias(id_col)).distinct()
    return docs.join(gone, id_col, "left_anti").select(*docs.columns)
