"""MinHash near-dedup with tensored banding.

Two small collections of `tables` hash groups each, of `rows` minhashes a group, are computed per document; a table key
combines one group of either collection, so tables**2 keys of 2 * rows minhashes cost only 2 * tables * rows minhashes.
A pair of similarity s meets in some table unless one whole collection fails: 1 - (1 - (1 - s**rows)**tables)**2.  With 3
and 15 that is 0.0005 at s = 0.75 and 0.00004 at 0.8.  Documents with the same shingle set are one node throughout.

Candidates never come as all pairs of a bucket.  First each bucket's members are compared with its smallest node; verified
links are contracted to components.  Nodes of buckets of three or more, which that may not have settled, meet again in the
hash groups of the first collection: 15 rows a node instead of up to 225, and a pair counts only if it shares a tensored key.
A group that still holds several components is dealt into blocks: members of its largest component, which need not meet
each other, lie in one block each, the others go to all of these and meet among themselves.  Tasks compare signatures of block
and block, each pair in one group only.  Members with a likely partner meet once more with their shingle sets, and tasks
give the links that tie components together.  Pairs are likely if their signatures agree on more than `least_agreement` of
the minhashes (0.58: 3.7 standard deviations below 0.75).  Every link is verified on the full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SHINGLE_WORDS, WordHashes, components, cut, cut_and_free, in_groups, joined, one_of_each, shingles

ROWS, TABLES = 3, 15
PERCENT = 75
LEAST_AGREEMENT = 0.58
BLOCK = 256
#: Shingles hashed at a time.
CHUNK = 2048


def hash_family(n: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(seed)
    return draw.integers(0, 2**64, n, np.uint64) | np.uint64(1), draw.integers(0, 2**64, n, np.uint64)


def minhashes(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The 32-bit minimum of each hash over the set, as signed integers."""
    low = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(values), CHUNK):
        part = values[i : i + CHUNK]
        np.minimum(low, (part[None, :] * a[:, None] + b[:, None]).min(1), out=low)
    return (low >> np.uint64(32)).astype(np.uint32).view(np.int32)


def shingle_set(text: bytes | None, words: WordHashes, k: int) -> np.ndarray:
    return np.unique(shingles(words.of(text or b""), k))


def signatures(df: DataFrame, id_col: str, text_col: str, k: int, rows: int, tables: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, set_id (128-bit hash of the set; null if empty), signature (2 * tables * rows minhashes)."""
    a, b = hash_family(2 * tables * rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sizes, ids, found = [], [], []
                for text in part.column(2).cast(pa.binary()).to_pylist():
                    s = shingle_set(text, words, k)
                    sizes.append(len(s))
                    ids.append(set_id(s) if len(s) else None)
                    found.append(minhashes(s, a, b) if len(s) else None)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()), pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "text_hash", "n_shingles", "set_id", "signature"])

    kind = df.select(id_col).schema[0].dataType.simpleString()
    return df.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, text_hash long, n_shingles long, set_id binary, signature array<int>")


def set_id(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def buckets(nodes: DataFrame, rows: int, tables: int) -> DataFrame:
    """(bucket, node): a row for each table in which a node can meet another.

    A key of the tensored tables is shared only where both its factors are, so factors that one node alone has are
    dropped before the factors are combined.
    """
    each = F.array(*(F.struct(F.lit(side == 1).alias("second"), group_hash(side, i, rows, tables).alias("factor")) for side in (0, 1) for i in range(tables)))
    factors = nodes.select("node", F.explode(each).alias("f")).select("node", "f.*")
    shared = factors.groupBy("factor").agg(F.count("*").alias("n")).where("n > 1").select("factor")
    met = factors.join(shared, "factor", "left_semi").groupBy("node").agg(F.collect_set(F.when(~F.col("second"), F.col("factor"))).alias("a"), F.collect_set(F.when(F.col("second"), F.col("factor"))).alias("b"))
    both = met.select("node", F.explode("a").alias("a"), "b").select("node", "a", F.explode("b").alias("b"))
    return both.select(F.xxhash64("a", "b").alias("bucket"), "node")


def group_hash(side: int, i: int, rows: int, tables: int) -> F.Column:
    return F.xxhash64(F.lit(side), F.lit(i), *(F.col("signature")[side * tables * rows + i * rows + r] for r in range(rows)))


def first_groups(members: DataFrame, rows: int, tables: int) -> DataFrame:
    """(bucket, table, node, component): a row for each hash group of the first collection."""
    each = F.array(*(F.struct(F.lit(i).alias("table"), group_hash(0, i, rows, tables).alias("bucket")) for i in range(tables)))
    return members.select("node", "component", F.explode(each).alias("g")).select("g.bucket", "g.table", "node", "component")


def agreement(x, y) -> F.Column:
    return F.size(F.filter(F.zip_with(x, y, lambda p, q: p == q), lambda e: e))


def likely(pairs: DataFrame, signed: DataFrame, least: float) -> DataFrame:
    """Pairs (x, y) whose signatures agree often enough."""
    both = pairs.join(signed.select(F.col("node").alias("x"), F.col("signature").alias("sx")), "x").join(signed.select(F.col("node").alias("y"), F.col("signature").alias("sy")), "y")
    return both.where(agreement("sx", "sy") > least * F.size("sx")).select("x", "y")


def shingle_sets(wanted: DataFrame, df: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """(node, shingles): the full sets of wanted (node, doc_id, text_hash), as sorted unsigned 64-bit numbers."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingle_set(t, words, k).tobytes() for t in part.column(1).cast(pa.binary()).to_pylist()], pa.binary())], names=["node", "shingles"])

    texts = df.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    found = texts.join(wanted.hint("shuffle_hash"), ["doc_id", "text_hash"]).select("node", "text")
    return found.mapInArrow(sets, "node long, shingles binary")


def linked(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    """100 * |intersection| >= percent * |union| of two sets given as sorted distinct numbers."""
    if percent * max(len(p), len(q)) > 100 * min(len(p), len(q)):
        return False
    both = len(np.intersect1d(p, q, assume_unique=True))
    return 100 * both >= percent * (len(p) + len(q) - both)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (x, y) that are linked by their full shingle sets."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = pa.array([linked(np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64), percent) for p, q in zip(b.column(2), b.column(3), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], names=["x", "y"])

    kind = sets.schema["node"].dataType.simpleString()
    both = pairs.join(sets.select(F.col("node").alias("x"), F.col("shingles").alias("sx")), "x").join(sets.select(F.col("node").alias("y"), F.col("shingles").alias("sy")), "y")
    return cut_and_free(both.select("x", "y", "sx", "sy").mapInArrow(compare, f"x {kind}, y {kind}").distinct())


def dealt(members: DataFrame, block: int) -> DataFrame:
    """Rows of members (bucket, table, node, component) in buckets of several components, with lo, hi, own: the groups that they
    are compared in.

    Members of the largest component are dealt into blocks -1, -2, ..., the others into blocks 0, 1, ..., by node hash.  A
    group (lo, hi) is one of the others' blocks with one block of either kind, so it holds no more than about two blocks, and
    the largest component is copied only as often as there are blocks of others.  members must be stored.
    """
    sizes = members.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("bucket").agg(F.max(F.struct("n", "component")).alias("most"), F.sum("n").alias("all")).where(F.col("all") > F.col("most.n"))
    count = lambda n: F.ceil(n / block).cast("int")
    split = largest.select("bucket", F.col("most.component").alias("major"), count(F.col("most.n")).alias("majors"), count(F.col("all") - F.col("most.n")).alias("minors"))
    mixed = joined(members, split, "bucket", nulls=False).where("major IS NOT NULL")
    hashed = lambda n: F.pmod(F.xxhash64("node", F.lit(3)), n).cast("int")
    minor = F.col("component") != F.col("major")
    own = F.when(minor, hashed("minors")).otherwise(-1 - hashed("majors"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    pair = lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"))
    with_majors = F.transform(upto("majors"), lambda j: pair(F.col("own"), -1 - j))
    among = F.transform(upto("minors"), lambda i: pair(F.least("own", i), F.greatest("own", i)))
    groups = F.when(minor, F.concat(with_majors, among)).otherwise(F.transform(upto("minors"), lambda i: pair(i, F.col("own"))))
    return mixed.withColumn("own", own).select("bucket", F.explode(groups).alias("g"), "own", "table", "node", "component").select("bucket", "g.lo", "g.hi", "own", "table", "node", "component")


def candidates(own, c, s, table: int, across: bool, least: float, rows: int, tables: int):
    """(i, others) of one group: members of different components whose signatures agree often enough, that share a table key,
    and for which this group of the first collection is the first that they share.  Each pair comes once."""
    names, sizes = np.unique(c, return_counts=True)
    if len(names) < 2:
        return
    largest, at = names[sizes.argmax()], np.arange(len(c))
    for i in np.flatnonzero(c != largest):
        same = s == s[i]
        # Pairs with the largest component, and each other pair once.
        other = (same.sum(1) > least * s.shape[1]) & ((c == largest) | ((c != c[i]) & (at > i)))
        if across:
            other &= own != own[i]
        where = np.flatnonzero(other)
        if len(where):
            groups = same[where].reshape(len(where), 2, tables, rows).all(3)
            where = where[(groups[:, 0].argmax(1) == table) & groups[:, 0, table] & groups[:, 1].any(1)]
            if len(where):
                yield i, where


def group_arrays(t: pa.Table, width: int) -> list[np.ndarray]:
    return [*(t.column(x).to_numpy() for x in ("lo", "hi", "own", "table", "component")), t.column("signature").chunk(0).flatten().to_numpy().reshape(t.num_rows, width)]


def unlike(members: DataFrame, least: float, rows: int = ROWS, tables: int = TABLES) -> DataFrame:
    """The rows of members (dealt(), with signature) that have a candidate in their group, without the signature."""
    names = [c for c in members.columns if c != "signature"]

    def find(t: pa.Table, edges: np.ndarray) -> Iterator[pa.RecordBatch]:
        lo, hi, own, table, c, s = group_arrays(t, 2 * tables * rows)
        hit = np.zeros(t.num_rows, bool)
        for a, e in zip(edges[:-1], edges[1:], strict=True):
            if e - a > 1:
                for i, where in candidates(own[a:e], c[a:e], s[a:e], table[a], lo[a] != hi[a], least, rows, tables):
                    hit[a + i] = hit[a + where] = True
        yield from t.select(names).filter(pa.array(hit)).combine_chunks().to_batches()

    return in_groups(members, ["bucket", "lo", "hi"], find, members.select(*names).schema)


def links_within(members: DataFrame, least: float, percent: int, rows: int = ROWS, tables: int = TABLES) -> DataFrame:
    """Links (x, y) between components in groups of members (dealt(), with signature and shingles).

    Once a link has tied two components of a group together, their other pairs are not compared.
    """

    def find(t: pa.Table, edges: np.ndarray) -> Iterator[pa.RecordBatch]:
        lo, hi, own, table, c, s = group_arrays(t, 2 * tables * rows)
        n, sets, out = t.column("node").to_numpy(), t.column("shingles").chunk(0), []
        of = lambda i: np.frombuffer(sets[int(i)].as_buffer(), np.uint64)
        for a, e in zip(edges[:-1], edges[1:], strict=True):
            above: dict = {}

            def top(x):
                while x in above:  # noqa: B023
                    x = above[x]  # noqa: B023
                return x

            for i, where in candidates(own[a:e], c[a:e], s[a:e], table[a], lo[a] != hi[a], least, rows, tables):
                p, x = of(a + i), top(c[a + i])
                for m in where:
                    y = top(c[a + m])
                    if x != y and linked(p, of(a + m), percent):
                        out.append((n[a + i], n[a + m]))
                        above[x] = x = y
        yield pa.RecordBatch.from_arrays([pa.array([min(p) for p in out], pa.int64()), pa.array([max(p) for p in out], pa.int64())], names=["x", "y"])

    return in_groups(members, ["bucket", "lo", "hi"], find, "x long, y long").distinct()


def judged(df: DataFrame, id_col: str, text_col: str, k: int, percent: int, rows: int, tables: int, least_agreement: float) -> DataFrame:
    """One row per row of df: doc_id, text_hash, n_shingles, component (a number; null if the row links with nothing), component_id, kept."""
    docs = cut(signatures(df, id_col, text_col, k, rows, tables).withColumn("row", F.monotonically_increasing_id()))
    # A node is a distinct set, named by one of its rows.
    nodes = cut_and_free(docs.where("set_id IS NOT NULL AND doc_id IS NOT NULL").groupBy("set_id").agg(F.min("row").alias("node"), F.min(F.struct("doc_id", "text_hash")).alias("first"), F.any_value("signature").alias("signature")))
    met = cut_and_free(buckets(nodes, rows, tables))
    hubs = met.groupBy("bucket").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1").select("bucket", "hub", (F.col("n") > 2).alias("several"))
    shared = cut_and_free(met.join(hubs, "bucket").where("node > hub"))
    del met, hubs
    signed = nodes.select("node", "signature")
    stars = cut_and_free(likely(shared.select(F.col("hub").alias("x"), F.col("node").alias("y")).distinct(), signed, least_agreement))
    wanted = shared.select("node").unionByName(shared.select(F.col("hub").alias("node"))).distinct()
    sets = cut_and_free(shingle_sets(wanted.join(nodes.select("node", "first.*"), "node"), df, id_col, text_col, k))
    links = verified(stars, sets, percent)

    # A pair that is alone in its bucket has been compared; nodes of buckets of several go on.
    crowd = shared.where("several")
    again = crowd.select("node").unionByName(crowd.select(F.col("hub").alias("node"))).distinct()
    left = again.join(components(links, "x", "y"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    near = cut_and_free(first_groups(left.join(signed, "node"), rows, tables))
    rest = cut_and_free(unlike(dealt(near, BLOCK).join(signed, "node"), least_agreement, rows, tables))
    more = cut_and_free(links_within(rest.join(signed, "node").join(sets, "node"), least_agreement, percent, rows, tables))

    final = components(links.unionByName(more), "x", "y")
    placed = cut_and_free(nodes.select("set_id", "node", F.col("first.doc_id").alias("first")).join(final, "node", "left").select("set_id", "first", F.coalesce("component", "node").alias("component")))
    labels = placed.groupBy("component").agg(F.min("first").alias("component_id"))
    by_set = joined(placed.select("set_id", "component"), labels, "component", nulls=False)
    named = docs.select("doc_id", "text_hash", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("set_id")).alias("set_id"))
    out = joined(named, by_set, "set_id")
    component_id = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "text_hash", "n_shingles", "component", component_id.alias("component_id"), F.coalesce(F.col("doc_id") == component_id, F.lit(True)).alias("kept"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, k: int = SHINGLE_WORDS, percent: int = PERCENT, rows: int = ROWS, tables: int = TABLES, least_agreement: float = LEAST_AGREEMENT) -> DataFrame:
    """One row per row of df: doc_id, n_shingles, component_id, kept.

    Words are [^\\x20\\x09-\\x0D]+ after lower-casing A-Z; a text of fewer than k words is one shingle; a text without
    words, or null, links with nothing.  Rows that repeat an id are documents of their own, which share it as their
    name.  A row with a null id links with nothing, has a null component and is kept.  An empty table gives no rows.
    """
    return judged(df, id_col, text_col, k, percent, rows, tables, least_agreement).select("doc_id", "n_shingles", "component_id", "kept")


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, k: int = SHINGLE_WORDS, percent: int = PERCENT, rows: int = ROWS, tables: int = TABLES, least_agreement: float = LEAST_AGREEMENT) -> DataFrame:
    """df with one row of each group of near copies, the one of the smallest id; columns and their order stay.

    Rows go, not ids: another text under the same id stays.  Of several rows of that id in one group one stays.
    """
    found = cut_and_free(judged(df, id_col, text_col, k, percent, rows, tables, least_agreement))
    lost = found.where("not kept").select("doc_id", "text_hash")
    several = cut_and_free(found.where("kept AND component IS NOT NULL").groupBy("component", "doc_id").agg(F.min("text_hash").alias("chosen"), F.count("*").alias("n")).where("n > 1"))
    repeated = not several.isEmpty()
    if repeated:
        again = found.where("kept").join(several.select("component", "doc_id", "chosen"), ["component", "doc_id"])
        lost = lost.unionByName(again.where("text_hash <> chosen").select("doc_id", "text_hash"))
    gone = lost.distinct().select(F.col("doc_id").alias("__lost_id"), F.col("text_hash").alias("__lost_hash"))
    rows_ = df.withColumn("__hash", F.xxhash64(text_col))
    left = rows_.join(gone.hint("shuffle_hash"), (F.col(id_col) == F.col("__lost_id")) & (F.col("__hash") == F.col("__lost_hash")), "left_anti")
    if repeated:
        left = one_of_each(left, several.select("doc_id", F.col("chosen").alias("hash")).distinct(), {id_col: "doc_id", "__hash": "hash"}, [F.col(text_col)])
    return left.drop("__hash")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Brute force over an inverted index of shingles: for small tables.
SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4])) END AS s FROM w),
u AS (SELECT doc_id, len(s) AS n, unnest(s) AS h FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, a.n + b.n AS total, count(*) AS c FROM u a JOIN u b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2, 3),
o AS (SELECT x, y FROM p WHERE 100 * c >= 75 * (total - c)),
l AS (SELECT x, y FROM o UNION ALL SELECT y, x FROM o),
r AS (SELECT DISTINCT x AS n, x AS c FROM l UNION SELECT l.y, r.c FROM r JOIN l ON l.x = r.n),
c AS (SELECT n, min(c) AS c FROM r GROUP BY n)
SELECT s.doc_id, len(s.s) AS n_shingles, coalesce(c.c, s.doc_id) AS component_id, coalesce(c.c, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN c ON c.n = s.doc_id
"""
