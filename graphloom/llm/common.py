"""What several operators share: the shared folder, lineage cuts, joins on hot keys, groups in Arrow, connected components, word shingles."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE_WORDS = 5
#: Entries after which a task's word cache starts anew (a cache only: results do not depend on it).
CACHE_WORDS = 400_000
#: A key is hot if more than one row in HOT holds it, so fewer than HOT keys are.
HOT = 256
#: Slices of the rows of a hot key whose other side is too large to broadcast.
SLICES = 64
#: Whether Spark removes the shuffle files of a query when it ends.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_HORNER = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2, _S33 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(33)


def shared_dir(spark: SparkSession) -> str:
    """The folder all nodes share, from spark.checkpoint.dir; a temporary one only where that is unset in local mode."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not path:
        current = sc._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="graphloom-")
        removed_at_exit(spark, path)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(path)
        removed_at_exit(spark, sc._jsc.sc().getCheckpointDir().get())
    return path


def removed_at_exit(spark: SparkSession, path: str) -> str:
    """path, a folder of intermediate data that goes when the driver ends."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return path


def own_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one; it goes when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(spark._jvm.org.apache.hadoop.fs.Path(path))
    return removed_at_exit(spark, path)


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and stored in the shared folder: its lineage ends there and survives lost executors.

    Shuffle files that led to it go as soon as it is stored.
    """
    spark = df.sparkSession
    shared_dir(spark)
    before = spark.conf.get(CLEAN_UP, "false")
    spark.conf.set(CLEAN_UP, "true")
    try:
        own = df.select("*")  # Spark reads the setting where a plan is made; what else is made of df keeps its shuffles
    finally:
        spark.conf.set(CLEAN_UP, before)
    return own.checkpoint(eager=True)


def cut_and_free(df: DataFrame) -> DataFrame:
    """cut(), and stored tables that led to df go soon: Spark drops those that nothing refers to any more only when the
    driver collects its garbage, which a driver with little to do may not do for half an hour."""
    jvm, out = df.sparkSession._jvm, cut(df)
    del df
    jvm.System.gc()
    return out


def hot_keys(counted: DataFrame, key: str) -> list:
    """Values of key that more than one row in HOT holds: fewer than HOT of them. counted must be stored, as it is read again."""
    total = counted.count()
    counts = counted.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    return [r[0] for r in counts.where(F.col("n") * HOT > total).limit(HOT).collect()]


def joined(wide: DataFrame, narrow: DataFrame, key: str, hot: list | None = None, fixed: bool = True, nulls: bool = True) -> DataFrame:
    """wide left joined with narrow, which has one row per key.

    Rows of hot keys (those of hot_keys(wide, key), unless given) meet their narrow rows, fewer than HOT, by broadcast if
    these are of a fixed size, else dealt over SLICES slices; rows without a key (none, unless nulls) meet nothing; only the
    others are shuffled by the key alone.
    """
    hot = hot_keys(wide, key) if hot is None else hot
    among = lambda df: F.coalesce(df[key].isin([F.lit(k) for k in hot]), F.lit(False))
    rest = wide.where(F.col(key).isNotNull()) if nulls else wide
    parts = [(rest.where(~among(rest)) if hot else rest).join(narrow.where(~among(narrow)) if hot else narrow, key, "left")]
    if hot:
        few, many = narrow.where(among(narrow)), rest.where(among(rest))
        if fixed:
            parts.append(many.join(F.broadcast(few), key, "left"))
        else:
            few = few.withColumn("__slice", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))))
            parts.append(many.withColumn("__slice", F.pmod(F.monotonically_increasing_id(), F.lit(SLICES)).cast("int")).join(few, [key, "__slice"], "left").drop("__slice"))
    if nulls:
        added = [F.lit(None).cast(f.dataType).alias(f.name) for f in narrow.schema if f.name != key]
        parts.append(wide.where(F.col(key).isNull()).select("*", *added))
    out = parts[0]
    for other in parts[1:]:
        out = out.unionByName(other)
    return out


def one_of_each(rows: DataFrame, repeated: DataFrame, keys: dict[str, str], order: list) -> DataFrame:
    """rows, of which those of each repeated key become one, the greatest by order; keys: columns of rows and of repeated."""
    again = repeated.select(*(F.col(c).alias(f"__again{i}") for i, c in enumerate(keys.values())), F.lit(True).alias("__again"))
    same = [F.col(c).eqNullSafe(F.col(f"__again{i}")) for i, c in enumerate(keys)]
    marked = rows.join(again.hint("shuffle_hash"), same, "left")
    once = marked.where(F.col("__again").isNull()).select(*rows.columns)
    one = marked.where("__again").groupBy(*(f"__again{i}" for i in range(len(keys)))).agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("__row"))
    return once.unionByName(one.select("__row.*"))


def in_groups(df: DataFrame, keys: list[str], work: Callable[[pa.Table, np.ndarray], Iterable[pa.RecordBatch]], schema, order: Iterable[str] = ()) -> DataFrame:
    """work(table, edges) over batches of whole groups of rows with equal keys; group i is rows edges[i] to edges[i + 1].

    Groups must be of bounded size.  Many small ones come at a time, so that a group costs no call of its own; the fixed
    number of partitions keeps small inputs of long work from being put together in one task.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartition(parts, *keys).sortWithinPartitions(*keys, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])]).combine_chunks()
            other = np.zeros(t.num_rows - 1, bool)
            for k in keys:
                c = t.column(k).chunk(0)
                other |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
            edges = np.r_[0, np.flatnonzero(other) + 1]
            held = t.slice(int(edges[-1])).combine_chunks()
            if len(edges) > 1:
                yield from work(t.slice(0, int(edges[-1])).combine_chunks(), edges)
        if held is not None:
            yield from work(held, np.array([0, held.num_rows]))

    return dealt.mapInArrow(run, schema)


def components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 50) -> DataFrame:
    """(node, component): the smallest node that each node of an edge reaches.

    Alternates large-star and small-star steps until the edge set is a forest of stars (logarithmically many rounds).
    Every round counts the edges at each node, which tells whether another is needed and which nodes are hot, looks up
    smallest neighbours twice, those of hot nodes by broadcast, and is written to the shared folder; what it has read and
    shuffled goes at once.  Nulls and loops contribute nothing.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u <> v")
    e = cut_and_free(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(max_rounds + 1):
        ends = ends_of(e)
        n_edges, open_, most_up, most_down = ends.agg(F.sum("up"), F.count_if((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))), F.max("up"), F.max("down")).first()
        if not open_:
            break
        hot = lambda side, most: [r[0] for r in ends.where(F.col(side) * HOT > n_edges).select("node").limit(HOT).collect()] if most * HOT > n_edges else []  # noqa: B023, E731
        e = starred(e, ends, hot("up", most_up), hot("down", most_down))
    else:
        raise RuntimeError("connected components did not settle")
    roots = e.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def ends_of(e: DataFrame) -> DataFrame:
    """(node, m, up, down) per node of distinct edges (u, v) with u > v: its smallest lower neighbour, the numbers of its lower and
    of its higher neighbours.  The edges are a forest of stars about their smallest nodes if no node has two lower
    neighbours, or one of either kind."""
    end = lambda node, low: F.struct(F.col(node).alias("node"), low.alias("low"))
    ends = e.select(F.explode(F.array(end("u", F.col("v")), end("v", F.lit(None).cast(e.schema["v"].dataType)))).alias("p")).select("p.*")
    return cut_and_free(ends.groupBy("node").agg(F.min("low").alias("m"), F.count("low").alias("up"), F.count_if(F.col("low").isNull()).alias("down")))


def starred(e: DataFrame, ends: DataFrame, hot_up: list, hot_down: list) -> DataFrame:
    """The edges after a large-star and a small-star step; hot_up, hot_down: hot higher and lower ends."""
    # Every edge's lower end gives way to its own smallest neighbour, if that is lower still; higher ends stay as frequent as they are.
    lower = ends.where("m IS NOT NULL").select(F.col("node").alias("v"), "m")
    large = cut_and_free(joined(e, lower, "v", hot_down, nulls=False).select("u", F.coalesce("m", "v").alias("v")))
    # All lower neighbours of a node, and it, go to the smallest of them.
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    small = joined(large, low, "u", hot_up, nulls=False).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("p")).select("p.*")
    return cut_and_free(small.where("u <> v").distinct())


class WordHashes(dict):
    """64-bit hashes of words given as bytes, remembered within a task."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, text: bytes) -> np.ndarray:
        """Of the words [^\\x20\\x09-\\x0D]+ of UTF-8 text after lower-casing A-Z (what bytes.lower and bytes.split do)."""
        words = text.lower().split()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S33)) * _MIX1
    x = (x ^ (x >> _S33)) * _MIX2
    return x ^ (x >> _S33)


def shingles(words: np.ndarray, k: int = SHINGLE_WORDS) -> np.ndarray:
    """A 64-bit hash per k-word shingle, in order; fewer words give one for the whole sequence; none give none."""
    n = len(words)
    if not n:
        return words
    k = min(k, n)
    out = words[: n - k + 1].copy()
    for i in range(1, k):
        out *= _HORNER
        out += words[i : n - k + 1 + i]
    return mixed(out + np.uint64(k))
