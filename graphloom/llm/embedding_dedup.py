"""Embedding near-dedup by NN-descent.

The neighbour graph starts from random-hyperplane cells, each split into blocks of bounded size; then rounds of local
joins compare the neighbours (and reverse neighbours) of every node with each other and keep the best.  A node whose list
is full of links is saturated: its list is enlarged by all members of its component, which are not listed any more, and
the descent goes on among the saturated nodes for others outside, until none is saturated.  Blocks of exact products
count the links inside components without listing pairs.  Recall is audited against brute force for a set of query vectors over all rows: a link
is found when both its ends are in one component; while recall is below the target, further cells and rounds follow.
If they help no more, or recall is not known, blocks of exact products over all rows join what is left.

The search reads vectors in single precision; links, their numbers and the exact products are of double precision.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, cut, in_groups, joined

log = logging.getLogger(__name__)
THRESHOLD = 0.9
#: Scores of single precision this close to the threshold are computed anew.
MARGIN = 1e-5
NEIGHBOURS = 12
CELL, BLOCK = 128, 512
#: Rows of a block of the exact finish, and of a slice of it.
WHOLE, SLICE = 4096, 128
FORESTS, ROUNDS = 4, 2
#: The search goes on until the audit finds RECALL, while a pass leaves at most HELPS of the loss before it.
RECALL, HELPS = 0.99, 0.9
#: Query vectors of the audit, each against all rows, so many of one component at most; more and more, up to MOST_AUDIT
#: (a documented bound), until LINKED of them have links.
AUDIT, MOST_AUDIT, PER_COMPONENT, LINKED = 256, 32768, 4, 32
#: vector: of unit length, as bytes; of double precision unless it is called small.
VECTOR = "node long, vector binary, component long"
LIST = "node long, other long, score double"
#: Below any cosine.
NOTHING = -2.0


def matrix(column, kind: type = np.float64) -> np.ndarray:
    """The rows of a column of vectors as bytes."""
    values = [v.as_buffer() for v in column] if isinstance(column, pa.Array | pa.ChunkedArray) else list(column)
    return np.frombuffer(b"".join(values), kind).reshape(len(values), -1)


def binary(x: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in x], pa.binary())


def unit_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, key, vector, small) of unit length; without vectors that are null, empty, zero or hold null or non-finite components."""

    def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, exact, small = [], [], []
            lists = b.column(1)
            flat, at = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            for i, (vec_id, there) in enumerate(zip(b.column(0).to_pylist(), lists.is_valid().to_pylist(), strict=True)):
                v = flat[at[i] : at[i + 1]] if there else flat[:0]
                top = np.abs(v).max(initial=0.0)
                # Null components came as NaN, for which no comparison holds.
                if vec_id is None or not 0 < top < np.inf:
                    continue
                # Divided by the largest component first: neither overflow nor underflow in the sum of squares.
                v = v / top
                v /= np.sqrt((v * v).sum())
                ids.append(vec_id)
                exact.append(v.tobytes())
                small.append(v.astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(exact, pa.binary()), pa.array(small, pa.binary())], names=["vec_id", "vector", "small"])

    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector")).mapInArrow(scale, "vec_id long, vector binary, small binary")
    return rows.withColumn("key", F.unhex(F.sha2("vector", 256)))


def mean_of(vectors: DataFrame) -> np.ndarray:
    """The mean of the small vectors; each task gives one sum."""

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, n = 0.0, 0
        for b in batches:
            if b.num_rows:
                out, n = out + matrix(b.column(0), np.float32).sum(0, dtype=np.float64), n + b.num_rows
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out))), pa.array(out), pa.array([n] * len(out))], names=["i", "x", "n"])

    sums = vectors.select("small").mapInArrow(total, "i long, x double, n long").groupBy("i").agg((F.sum("x") / F.sum("n")).alias("m"))
    return np.array([r["m"] for r in sums.orderBy("i").collect()])


def best(lists: DataFrame, k: int) -> DataFrame:
    """The k most similar others of each node, from rows (node, other, score, fresh); fresh stays only what no older row has."""

    def choose(t: pa.Table, edges: np.ndarray) -> Iterator[pa.RecordBatch]:
        node, other, score, fresh = (t.column(c).to_numpy() for c in ("node", "other", "score", "fresh"))
        order = np.lexsort((fresh, -score, other, node))
        node, other, score, fresh = node[order], other[order], score[order], fresh[order]
        first = np.r_[True, (node[1:] != node[:-1]) | (other[1:] != other[:-1])]
        # Of equal pairs any old one makes it old.
        old = np.bitwise_and.reduceat(fresh.astype(np.int8), np.flatnonzero(first)).astype(bool)
        node, other, score, fresh = node[first], other[first], score[first], old
        order = np.lexsort((other, -score, node))
        node = node[order]
        starts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        place = np.arange(len(node)) - np.repeat(starts, np.diff(np.r_[starts, len(node)]))
        keep = order[place < k]
        yield pa.RecordBatch.from_arrays([pa.array(node[place < k]), pa.array(other[keep]), pa.array(score[keep]), pa.array(fresh[keep])], names=["node", "other", "score", "fresh"])

    return in_groups(lists, ["node"], choose, f"{LIST}, fresh boolean")


def top_pairs(ids: np.ndarray, groups: np.ndarray, x: np.ndarray, k: int, floor: np.ndarray | None = None, fresh: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, other, score) of the k best others of each row of x among the rows of other groups; rows of one id are of one group.

    Only scores above floor, by row, count; of rows that are not fresh, only fresh partners.
    """
    g = (x @ x.T).astype(np.float64)
    g[groups[:, None] == groups[None, :]] = -np.inf
    if floor is not None:
        g[g <= floor[:, None]] = -np.inf
    if fresh is not None:
        g[~(fresh[:, None] | fresh[None, :])] = -np.inf
    k = min(k, len(ids) - 1)
    if k < 1:
        return ids[:0], ids[:0], np.zeros(0)
    at = np.argpartition(-g, k - 1, axis=1)[:, :k]
    score = np.take_along_axis(g, at, 1)
    there = np.isfinite(score)
    return np.repeat(ids, there.sum(1)), ids[at[there]], score[there]


def of_groups(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    if found:
        node, other, score = (np.concatenate(x) for x in zip(*found, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(other), pa.array(score)], names=["node", "other", "score"])


def cells(vectors: DataFrame, n: int, centres: list[np.ndarray], seeds: range, k: int) -> DataFrame:
    """First lists: for each seed the vectors are dealt by the signs of random projections of their offset from a centre.

    Seeds take the centres in turn.  About the mean cells are of like size, but two groups on opposite sides of it share
    none, however close they are; about the origin they do.  A cell over BLOCK vectors (copies all fall into one) is dealt into blocks by id; a block is one task's work.
    """
    bits = max(0, math.ceil(math.log2(max(n, 1) / CELL)))
    planes = [np.random.default_rng(s).standard_normal((len(centres[0]), bits)) for s in seeds]
    offsets = [centres[i % len(centres)] @ p for i, p in enumerate(planes)]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = 1 << np.arange(bits)
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column(1), np.float32).astype(np.float64)
            codes = np.stack([((x @ p) > o) @ weights if bits else np.zeros(len(x), np.int64) for p, o in zip(planes, offsets, strict=True)], 1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(codes.tolist(), pa.list_(pa.int64()))], names=["node", "vector", "component", "codes"])

    dealt = cut(vectors.select("node", "vector", "component").mapInArrow(deal, f"{VECTOR}, codes array<long>").select("node", "vector", "component", F.posexplode("codes").alias("seed", "code")))
    cell = dealt.withColumn("cell", F.shiftleft(F.col("code"), 8) + F.col("seed"))
    large = cell.groupBy("cell").agg(F.count("*").alias("size")).where(F.col("size") > BLOCK).select("cell", F.ceil(F.col("size") / BLOCK).alias("blocks"))
    parts = cell.join(large, "cell", "left").withColumn("block", F.pmod(F.xxhash64("node", "seed"), F.coalesce("blocks", F.lit(1))))

    def compare(t: pa.Table, edges: np.ndarray) -> Iterator[pa.RecordBatch]:
        node, component, x = t.column("node").to_numpy(), t.column("component").to_numpy(), matrix(t.column("vector"), np.float32)
        yield from of_groups([top_pairs(node[a:e], component[a:e], x[a:e], k) for a, e in zip(edges[:-1], edges[1:], strict=True) if e - a > 1])

    found = in_groups(parts.select("cell", "block", "node", "vector", "component"), ["cell", "block"], compare, LIST)
    return best(found.withColumn("fresh", F.lit(True)), k)


def local_join(lists: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """A round: the neighbours and the best reverse neighbours of each node are compared with each other, and a node enters
    the lists of its neighbours.

    Pairs that were both around the node a round ago have been compared already.  Reverse lists are cut to the k best, as
    in the published method: nothing is lost that a list holds.
    """
    turned = lists.select(F.col("other").alias("node"), F.col("node").alias("other"), "score", "fresh")
    around = lists.unionByName(best(turned, k)).groupBy("node", "other").agg(F.max("fresh").alias("fresh"))
    # The least score of a full list: only what can enter a list is given.
    floor = lists.groupBy("node").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(NOTHING).alias("floor"))
    held = vectors.select("node", "vector", "component").join(floor, "node", "left").select(F.col("node").alias("other"), "vector", "component", F.coalesce("floor", F.lit(NOTHING)).alias("floor"))
    near = cut(around).join(held, "other")

    def compare(t: pa.Table, edges: np.ndarray) -> Iterator[pa.RecordBatch]:
        other, component, floor, fresh = (t.column(c).to_numpy() for c in ("other", "component", "floor", "fresh"))
        x = matrix(t.column("vector"), np.float32)
        yield from of_groups([top_pairs(other[a:e], component[a:e], x[a:e], k, floor[a:e], fresh[a:e]) for a, e in zip(edges[:-1], edges[1:], strict=True) if e - a > 1 and fresh[a:e].any()])

    found = in_groups(near, ["node"], compare, LIST)
    return best(lists.withColumn("fresh", F.lit(False)).unionByName(turned.withColumn("fresh", F.lit(True))).unionByName(found.withColumn("fresh", F.lit(True))), k)


def audit(vectors: DataFrame, threshold: float, k: int, seed: int = 17) -> float | None:
    """Recall of links as returned: those of query vectors by brute force over all rows whose ends are in one component.

    Queries are the vectors of smallest hash, PER_COMPONENT of a component at most, sent to every task: a large group cannot
    stand for the table.  Each query with links counts once, with the share found of its links, at most the k least
    similar ones, so that its own close group does not hide what is lost.  If fewer than LINKED queries have links, eight
    times as many are asked.  None says that MOST_AUDIT queries were too few; if all rows were asked and none has a link,
    recall is 1.
    """
    ranked = vectors.withColumn("hash", F.xxhash64("node", F.lit(seed))).selectExpr("*", "row_number() OVER (PARTITION BY component ORDER BY hash, node) AS place")
    spread = ranked.where(F.col("place") <= PER_COMPONENT).select("node", "vector", "component", "hash")
    queries = AUDIT
    while True:
        asked = spread.orderBy("hash", "node").limit(queries).toPandas()
        ids, q, own = asked["node"].to_numpy(), matrix(asked["vector"], np.float32), asked["component"].to_numpy()

        def run(batches: Iterator[pa.RecordBatch], ids=ids, q=q, own=own) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                node, x, component = b.column(0).to_numpy(), matrix(b.column(1), np.float32), b.column(2).to_numpy()
                for at in range(0, len(ids), AUDIT):
                    part = slice(at, at + AUDIT)
                    score = (q[part] @ x.T).astype(np.float64)
                    # What single precision leaves in doubt is not asked.
                    of, to = np.nonzero((score >= threshold + MARGIN) & (ids[part, None] != node[None, :]))
                    found = pd.DataFrame({"query": of + at, "score": score[of, to], "found": own[part][of] == component[to]})
                    # Only the k least similar links of a query count.
                    found = found.sort_values(["query", "score", "found"]).groupby("query").head(k)
                    yield pa.RecordBatch.from_arrays([pa.array(found[c].to_numpy()) for c in found], names=list(found))

        links = vectors.select("node", "vector", "component").mapInArrow(run, "query long, score double, found boolean").selectExpr("*", "row_number() OVER (PARTITION BY query ORDER BY score, found) AS place")
        shares = links.where(F.col("place") <= k).groupBy("query").agg(F.avg(F.col("found").cast("int")).alias("share"))
        row = shares.agg(F.count("*"), F.avg("share")).first()
        # Fewer queries came than were asked for: there are no more.
        if row[0] >= LINKED or len(asked) < queries:
            return row[1] if row[0] else 1.0
        if queries >= MOST_AUDIT:
            return None
        queries *= 8


def paired(sized: DataFrame, *more: str) -> DataFrame:
    """(component, lo, hi, own, node, vector and more) for each pair of blocks (lo, hi) that rows of own, one of the two, meet in; blocks is their number."""
    own = F.pmod(F.xxhash64("node", F.lit(5)), "blocks").cast("int")
    dealt = sized.select("component", "node", "vector", *more, own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    return dealt.select("component", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "node", "vector", *more)


def links_between(vectors: DataFrame, n: int, threshold: float) -> DataFrame:
    """(node, other): components, as their smallest nodes, that links join, by exact products over all n rows.

    A pair of blocks gives a forest of its links only, no row per link.
    """
    dealt = paired(vectors.withColumn("blocks", F.lit(math.ceil(n / WHOLE))))

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        x, own = matrix(pdf["vector"]), pdf["own"].to_numpy()
        names, label = np.unique(pdf["component"].to_numpy(), return_inverse=True)
        left, right = np.flatnonzero(own == pdf["lo"].iloc[0]), np.flatnonzero(own == pdf["hi"].iloc[0])
        y, root, out = x[right].T, np.arange(len(names)), []

        def top(a: int) -> int:
            while root[a] != a:
                root[a] = a = root[root[a]]
            return a

        for at in range(0, len(left), SLICE):
            rows = left[at : at + SLICE]
            i, j = np.nonzero((x[rows] @ y >= threshold) & (label[rows, None] != label[None, right]))
            for a, b in zip(*np.divmod(np.unique(label[rows][i] * len(names) + label[right][j]), len(names)), strict=True):
                u, v = top(a), top(b)
                if u != v:
                    root[max(u, v)] = min(u, v)
                    out.append((names[a], names[b]))
            label = np.array([top(a) for a in range(len(names))])[label]
        return pd.DataFrame(out, columns=["node", "other"]).astype("int64")

    return dealt.groupBy("lo", "hi").applyInPandas(join, "node long, other long").distinct()


def within(members: DataFrame, threshold: float) -> DataFrame:
    """(key, n_links): exact numbers of links inside components, block by block, without a row per link.

    members: node, component, key, weight (the vectors that a key stands for), vector; stored, as they are read twice.
    """
    sizes = members.groupBy("component").agg(F.count("*").alias("n"))
    several = joined(members, sizes, "component", nulls=False).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    dealt = paired(several, "key", "weight")

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        x, ids, own = matrix(pdf["vector"]), pdf["node"].to_numpy(), pdf["own"].to_numpy()
        linked = (x @ x.T >= threshold) & (ids[:, None] != ids[None, :])
        if pdf["lo"].iloc[0] != pdf["hi"].iloc[0]:
            linked &= own[:, None] != own[None, :]
        return pd.DataFrame({"key": pdf["key"], "n_links": linked @ pdf["weight"].to_numpy()})

    return dealt.groupBy("component", "lo", "hi").applyInPandas(count, "key binary, n_links long").groupBy("key").agg(F.sum("n_links").alias("n_links"))


def descent(vectors: DataFrame, n: int, centres: list[np.ndarray], seeds: range, k: int, lists: DataFrame | None = None) -> DataFrame:
    """(node, other, score, fresh): lists of the k best others outside each node's component, from new cells and the given lists."""
    new = cells(vectors, n, centres, seeds, k)
    lists = cut(new if lists is None else best(lists.unionByName(new), k))
    for _ in range(ROUNDS):
        lists = cut(local_join(lists, vectors, k))
    return lists


def merged(vectors: DataFrame, links: DataFrame) -> DataFrame:
    """vectors with the components that links (node, other) join made one."""
    stars = vectors.select("node", F.col("component").alias("other"))
    found = components(stars.unionByName(links.select("node", "other")), "node", "other")
    return cut(vectors.select("node", "vector").join(found, "node", "left").select("node", "vector", F.coalesce("component", "node").alias("component")))


def linked(lists: DataFrame, exact: DataFrame, threshold: float) -> DataFrame:
    """(node, other) of lists whose cosine in double precision is at least threshold; exact: node, vector."""
    near = lists.where(F.col("score") >= threshold - MARGIN)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                keep = pa.array((matrix(b.column(2)) * matrix(b.column(3))).sum(1) >= threshold)
                yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], names=["node", "other"])

    doubtful = near.where(F.col("score") < threshold + MARGIN).select("node", "other")
    both = doubtful.join(exact.select("node", F.col("vector").alias("x")), "node").join(exact.select(F.col("node").alias("other"), F.col("vector").alias("y")), "other")
    return near.where(F.col("score") >= threshold + MARGIN).select("node", "other").unionByName(both.select("node", "other", "x", "y").mapInArrow(compare, "node long, other long")).distinct()


def enlarged(vectors: DataFrame, exact: DataFrame, lists: DataFrame, centres: list[np.ndarray], threshold: float, k: int, seed: int) -> DataFrame:
    """vectors with the components of the links in lists and of those that full lists had no room for.

    A link that both its ends had no room for joins two saturated nodes.  They search on among themselves, with lists for
    others outside their component only; a list full of links again merges k nodes or more, so the turns come to an end.
    """
    while True:
        links = cut(linked(lists, exact, threshold))
        vectors = merged(vectors, links)
        full = cut(links.groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") >= k).select("node"))
        n = full.count()
        if not n:
            return vectors
        lists = descent(cut(vectors.join(full, "node", "left_semi")), n, [np.zeros_like(centres[0]), *centres], range(seed, seed + FORESTS), k)
        seed += FORESTS


def neighbour_graph(nodes: DataFrame, threshold: float = THRESHOLD, k: int = NEIGHBOURS, tied: DataFrame | None = None) -> tuple[DataFrame, float]:
    """(node, component) of nodes (node, vector, small) and the audited recall of links at the threshold; nodes that link with nothing are
    components of their own.  tied (node, other): nodes that are one whatever their vectors."""
    first = nodes.agg(F.count("*").alias("n"), F.max(F.length("vector")).alias("size"), F.min(F.length("vector")).alias("least")).first()
    n = first["n"]
    if first["least"] != first["size"]:
        raise ValueError("vectors of different lengths")
    mean, exact = mean_of(nodes), nodes.select("node", "vector")
    vectors = nodes.select("node", F.col("small").alias("vector"), F.col("node").alias("component"))
    if tied is not None:
        vectors = merged(vectors, tied)
    lists, turn, centres, before = None, 0, [mean], math.inf
    while True:
        lists = descent(vectors, n, centres, range(1000 * turn, 1000 * turn + FORESTS), k, lists)
        vectors = enlarged(vectors, exact, lists, [mean], threshold, k, 1000 * turn + FORESTS)
        recall = audit(vectors, threshold, k, 17 + turn)
        log.info("recall of links at %s after pass %s: %s", threshold, turn + 1, recall)
        if recall is not None and recall >= RECALL:
            return vectors.select("node", "component").distinct(), recall
        if recall is None or 1 - recall > HELPS * before:
            log.warning("recall of links at %s is %s: exact products over all %s rows follow", threshold, recall, n)
            return merged(vectors, links_between(exact.join(vectors.select("node", "component").distinct(), "node"), n, threshold)).select("node", "component").distinct(), 1.0
        # Links are inside components now and leave room for others.
        lists, before, turn, centres = lists.where(F.col("score") < threshold - MARGIN), 1 - recall, turn + 1, [mean, np.zeros_like(mean)]


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *, threshold: float = THRESHOLD, k: int = NEIGHBOURS) -> DataFrame:
    """One row per row of df: vec_id, n_links, component_id, kept.

    Vectors that are null, zero or hold null or non-finite components link with nothing.  Equal vectors are one node of the
    search.  Rows that repeat an id are one vector, linked if any of them is; a null id links with nothing, has a null
    component and is kept.  An empty table gives no rows; vectors of different lengths raise ValueError.
    """
    vectors = cut(unit_vectors(df, id_col, vector_col))
    rows = df.select(F.col(id_col).alias("vec_id"))
    if vectors.isEmpty():
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"), F.lit(True).alias("kept"))
    nodes = cut(vectors.groupBy("key").agg(F.min("vec_id").alias("node"), F.count_distinct("vec_id").alias("weight"), F.any_value("vector").alias("vector"), F.any_value("small").alias("small")))
    held = cut(joined(vectors.select("vec_id", "key"), nodes.select("key", "node"), "key", nulls=False).distinct())
    repeated = held.groupBy("vec_id").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("vec_id", "low")
    tied = cut(held.join(repeated, "vec_id").select(F.col("low").alias("node"), F.col("node").alias("other")))
    labels, _ = neighbour_graph(nodes, threshold, k, None if tied.isEmpty() else tied)
    found = cut(nodes.join(labels, "node").select("node", "key", "weight", "component", "vector"))
    counts = within(found, threshold)
    by_key = found.join(counts, "key", "left").select("key", (F.coalesce("n_links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component")
    labelled = joined(held.select("vec_id", "key"), by_key, "key", nulls=False).groupBy("vec_id").agg(F.sum("n_links").alias("n_links"), F.min("component").alias("component"))
    out = joined(rows.withColumn("linked", F.col("vec_id").cast("long")), labelled.withColumnRenamed("vec_id", "linked"), "linked", [])
    component = F.coalesce("component", F.col("vec_id").cast("long"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: Brute force over all pairs: for small tables.
SQL = """
WITH RECURSIVE d AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
v AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS u FROM d
      WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_dot_product(a.u, b.u) >= 0.9),
r AS (SELECT DISTINCT x AS n, x AS c FROM l UNION SELECT l.y, r.c FROM r JOIN l ON l.x = r.n),
c AS (SELECT n, min(c) AS c FROM r GROUP BY n),
k AS (SELECT x, count(*) AS n FROM l GROUP BY x)
SELECT d.vec_id, coalesce(k.n, 0) AS n_links, coalesce(c.c, d.vec_id) AS component_id, coalesce(c.c, d.vec_id) = d.vec_id AS kept
FROM d LEFT JOIN k ON k.x = d.vec_id LEFT JOIN c ON c.n = d.vec_id
"""
