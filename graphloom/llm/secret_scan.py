"""Secret scans over an incremental blob ledger, in DataFrame functions only.

Each version of each path is content-addressed by the SHA-256 of its text.  The ledger - a Parquet folder - remembers
which (blob, rule version) pairs have been scanned and what was found, so only unseen pairs are scanned, one copy of each
blob; findings are then joined back to every path that ever held the blob.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, hot_keys, joined, own_folder


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of pattern (Java syntax); those whose group is shorter than least are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    #: A plain string that every match contains: a cheap test before the regular expression.
    needs: str | None = None

    @property
    def version(self) -> str:
        return hashlib.sha256(f"{self.kind}\0{self.pattern}\0{self.group}\0{self.least}".encode()).hexdigest()[:16]


# Runs of [0-9a-f] and of AKIA[A-Z0-9]+ take their minimum length into the pattern: a run that is too short holds no other match.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}", needs="AKIA"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
#: Formats of other well-known credentials.
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z0-9\x20]*PRIVATE KEY-----", needs="PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", needs="gh"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", needs="eyJ"),
)
RULES = BASE + MORE
SPAN = "struct<start:bigint,no:int,end:bigint,kind:string,version:string>"
LEDGER = f"blob binary, versions array<string>, spans array<{SPAN}>, has_spans int"


def spans(text: Column, rule: Rule, no: int) -> Column:
    """Matches as an array of SPAN: the pieces between matches and the matches themselves give the code point offsets."""
    hit = text.rlike(rule.pattern)
    if rule.needs:
        hit = F.contains(text, F.lit(rule.needs)) & hit
    pattern = F.lit(rule.pattern)
    parts = F.arrays_zip(
        F.transform(F.split(text, rule.pattern), F.length).alias("gap"),
        F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.length).alias("size"),
        F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.length).alias("value"),
    )

    def step(done: Column, p: Column) -> Column:
        start = done["at"] + p["gap"]
        end = start + F.coalesce(p["size"], F.lit(0))
        span = F.struct(start.cast("long").alias("start"), F.lit(no).alias("no"), end.cast("long").alias("end"), F.lit(rule.kind).alias("kind"), F.lit(rule.version).alias("version"))
        return F.struct(end.cast("long").alias("at"), F.when(p["value"] >= max(rule.least, 1), F.array_append(done["found"], span)).otherwise(done["found"]).alias("found"))

    empty = F.array().cast(f"array<{SPAN}>")
    found = F.aggregate(parts, F.struct(F.lit(0).cast("long").alias("at"), empty.alias("found")), step, lambda x: x["found"])
    return F.when(hit, found).otherwise(empty)


def update(history: DataFrame, ledger: str, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scans the (blob, rule version) pairs of history that the ledger lacks and adds them to it; returns (doc_id, blob) per row."""
    spark = history.sparkSession
    versions = F.array(*(F.lit(r.version) for r in rules))
    source = history.select(F.col(id_col).alias("doc_id"), content(text_col).alias("text"), address(text_col).alias("blob"))
    paths = cut(source.select("doc_id", "blob"))
    # Of the rows that hold a blob those of the smallest id are read again; same is their number, nearly always one.
    todo = paths.groupBy("blob", "doc_id").agg(F.count("*").alias("same")).groupBy("blob").agg(F.min(F.struct("doc_id", "same")).alias("any"))
    if exists(spark, ledger):
        seen = spark.read.schema(LEDGER).parquet(ledger).groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_set("versions"))).alias("seen"))
        todo = todo.join(seen, "blob", "left").withColumn("due", F.array_except(versions, F.coalesce("seen", F.array().cast("array<string>"))))
    else:
        todo = todo.withColumn("due", versions)
    todo = todo.where(F.size("due") > 0).select(F.col("blob").alias("todo_blob"), F.col("any.doc_id").alias("any_id"), F.col("any.same").alias("same"), "due")
    # (blob, id) spreads copies of one text over the partitions; the narrow side is the one held in memory.
    fresh = source.join(todo.hint("shuffle_hash"), (F.col("blob") == F.col("todo_blob")) & F.col("doc_id").eqNullSafe(F.col("any_id"))).select("blob", "text", "due", "same")
    if not todo.where("same > 1").isEmpty():
        fresh = fresh.where("same = 1").unionByName(fresh.where("same > 1").dropDuplicates(["blob"]))
    found = [F.when(F.array_contains("due", r.version), spans(F.col("text"), r, i)) for i, r in enumerate(rules)]
    scanned = fresh.select("blob", F.col("due").alias("versions"), F.flatten(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("spans"))
    # Findings lie apart, so that they are read without the many blobs that have none.
    scanned.withColumn("has_spans", (F.size("spans") > 0).cast("int")).write.mode("append").partitionBy("has_spans").parquet(ledger)
    return paths


def findings(spark: SparkSession, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, spans) of the blobs in which the given rules found something, by start, then rule."""
    versions = F.array(*(F.lit(r.version) for r in rules))
    order = F.create_map(*(F.lit(x) for i, r in enumerate(rules) for x in (r.version, i)))
    now = spark.read.schema(LEDGER).parquet(ledger).where("has_spans = 1").groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_set("spans"))).alias("spans"))
    current = F.transform(F.filter("spans", lambda s: F.array_contains(versions, s["version"])), lambda s: s.withField("no", order[s["version"]]))
    return now.select("blob", F.array_sort(current).alias("spans")).where(F.size("spans") > 0)


def scan(history: DataFrame, ledger: str, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per row of history: doc_id, blob, spans (array of SPAN by start, then rule).

    history has a row for each version of each path; null text counts as empty, repeated rows and null ids give a row
    each, an empty table none.  ledger is a folder in storage that all nodes share; it is created or added to.
    """
    paths = update(history, ledger, id_col, text_col, rules)
    found = findings(history.sparkSession, ledger, rules)
    return joined(paths, found, "blob", fixed=False, nulls=False).select("doc_id", "blob", F.coalesce("spans", F.array().cast(f"array<{SPAN}>")).alias("spans"))


def redact(df: DataFrame, ledger: str, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """df with found secrets replaced in its texts; other columns and their order stay."""
    paths = update(df, ledger, id_col, text_col, rules)
    found = findings(df.sparkSession, ledger, rules).select(F.col("blob").alias("__blob"), F.col("spans").alias("__spans"))
    both = joined(df.withColumn("__blob", address(text_col)), found.hint("shuffle_hash"), "__blob", hot_keys(paths, "blob"), fixed=False, nulls=False)
    return both.select(*(F.when(F.col("__spans").isNotNull(), redacted(F.col(c), F.col("__spans"))).otherwise(F.col(c)).alias(c) if c == text_col else F.col(c) for c in df.columns))


def content(text_col: str) -> Column:
    return F.coalesce(F.col(text_col), F.lit(""))


def address(text_col: str) -> Column:
    return F.unhex(F.sha2(content(text_col), 256))


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def new_ledger(spark: SparkSession) -> str:
    """The place of a ledger that lasts as long as the driver; one that is to be added to later lies where the caller says."""
    return f"{own_folder(spark, 'ledger')}/blobs"


def redacted(text: Column, found: Column) -> Column:
    """text with each span, or run of overlapping spans, replaced by <kind> of its first rule."""

    def step(done: Column, s: Column) -> Column:
        keep = F.when(s["start"] >= done["at"], F.concat(F.substr(text, (done["at"] + 1).cast("int"), (s["start"] - done["at"]).cast("int")), F.lit("<"), s["kind"], F.lit(">"))).otherwise(F.lit(""))
        return F.struct(F.greatest(done["at"], s["end"]).alias("at"), F.concat(done["out"], keep).alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    return F.aggregate(found, start, step, lambda x: F.concat(x["out"], F.substr(text, (x["at"] + 1).cast("int"))))


def digest(found: DataFrame) -> DataFrame:
    text = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"].isin([r.kind for r in BASE]))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(r.kind) for r in BASE]
    return found.select("doc_id", *counts, F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), new_ledger(spark)))


def _sql() -> str:
    """The same spans in DuckDB: lengths of the pieces between matches and of the matches give the offsets."""
    words = "|".join("".join(f"[{c}{c.upper()}]" for c in w) for w in ("password", "passwd", "secret", "token"))
    # Letters in either case are spelled out: (?i) would also take letters beyond ASCII there.
    spelled = {"assign": rf"""({words}|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""}
    parts = []
    for no, r in enumerate(RULES):
        p = f"'{spelled.get(r.kind, r.pattern)}'"
        lists = f"list_transform(regexp_split_to_array(t, {p}), lambda x: length(x)) AS g, list_transform(regexp_extract_all(t, {p}, 0), lambda x: length(x)) AS m, list_transform(regexp_extract_all(t, {p}, {r.group}), lambda x: length(x)) AS v"
        parts.append(f"SELECT doc_id, {no} AS no, '{r.kind}' AS kind, unnest(list_filter(list_transform(range(1, len(m) + 1), lambda i: {{'s': coalesce(list_sum(g[1:i]), 0) + coalesce(list_sum(m[1:i-1]), 0), 'n': m[i], 'v': v[i]}}), lambda x: x.v >= {max(r.least, 1)})) AS x FROM (SELECT doc_id, {lists} FROM d)")
    found = " UNION ALL ".join(parts)
    base = ", ".join(f"'{r.kind}'" for r in BASE)
    text = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, no)"
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{r.kind}') AS n_{r.kind}" for r in BASE)
    return f"WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS (SELECT doc_id, no, kind, x.s::BIGINT AS s, (x.s + x.n)::BIGINT AS e FROM ({found})) SELECT d.doc_id, {counts}, sha256(coalesce({text} FILTER (WHERE kind IN ({base})), '')) AS base_sha256, coalesce({text}, '') AS spans FROM d LEFT JOIN f ON f.doc_id = d.doc_id GROUP BY d.doc_id"


SQL = _sql()
