"""SentencePiece encoding and decoding as a max-plus parallel scan.

A text of up to `chunk` characters is encoded in one task.  A giant one is cut into chunks anywhere; at a boundary the
state is how many characters of the next chunk the crossing piece covers.  Each chunk gives a matrix of best scores from
entry state to exit state.  Matrices are combined associatively, in groups and then per text, which gives the best scores
of all states at every boundary.  With them a chunk knows from which entry state the best path to each exit state comes;
these tables are composed associatively from the end, and each chunk then traces its own pieces back, apart from the others.

Of equal scores the longest last piece stays, as in one pass over the whole text: at every place of a chunk the scores and
the pieces they come from are those of that pass (up to a constant), so the ids do not depend on where the cuts lie.

The vocabulary file at hand is of the BPE kind, whose merges are no best-path problem; it is read as a unigram model (see
unigram.py), and results are those of the SentencePiece library for that model.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, in_groups, joined
from .unigram import NEVER, SPACE, Unigram, split_words

CHUNK = 16384
GROUP = 64
#: Chunks whose words are learned together.
TOGETHER = 64
#: Keys of giant texts that a task remembers, so as not to cut the same text again.
KNOWN_KEYS = 100_000
_CUT = re.compile(f"(?<=[^{SPACE}]){SPACE}")
#: What the digest has of a piece; see measured().
MEASURED, MEASURED_SCHEMA = ("right", "n", "hash"), "right boolean, n long, hash long"
PRIME, BASE = (1 << 31) - 1, 1_000_003
POWERS = np.array([pow(BASE, i, PRIME) for i in range(1 << 15)], np.int64)


def cuts(text: str, start: int, end: int) -> tuple[int, int] | None:
    """The first and last place in [start, end) that no piece crosses: a space mark after another character."""
    found = _CUT.search(text, start, end)
    if found is None:
        return None
    last = end
    while True:
        last = text.rindex(SPACE, start, last)
        if text[last - 1] != SPACE:
            return found.end() - 1, last


def transfer(model: Unigram, text: str, size: int) -> np.ndarray:
    """Best scores from each entry state to each exit state of a chunk of size characters, up to a constant; text goes on past it.

    No piece crosses the edges that cuts() gives, so the matrix is an outer sum of a head, a middle and a tail.  The
    middle is one number on all paths alike: it has no say in which states are best and is left out.
    """
    states = model.longest
    out = np.full((states, states), NEVER, np.int64)
    edges = cuts(text, 1, size)
    if edges is None:
        for s in range(min(states, size + 1)):
            best, _ = model.paths(text, {s: 0}, size)
            out[s, : len(best) - size] = best[size:][:states]
        return out
    first, last = edges
    head = np.full(states, NEVER, np.int64)
    for s in range(min(states, first + 1)):
        head[s] = model.paths(text[:first], {s: 0}, first)[0][first]
    best, _ = model.paths(text[last:], {0: 0}, size - last)
    tail = np.full(states, NEVER, np.int64)
    ends = best[size - last :][:states]
    tail[: len(ends)] = ends
    return plus(head[:, None], tail[None, :])


def plus(x, y) -> np.ndarray:
    return np.where((x <= NEVER) | (y <= NEVER), NEVER, np.add(x, y))


def product(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Max-plus product of matrices, or of a vector and a matrix."""
    return plus(x[..., :, None], y[None, ...] if x.ndim > 1 else y).max(-2)


def reached(matrices: list[np.ndarray], entry: np.ndarray) -> list[np.ndarray]:
    """Best scores of all states before each matrix, from those before the first one."""
    out = [entry]
    for m in matrices[:-1]:
        out.append(product(out[-1], m))
    return out


def head_of(text: str, size: int) -> str:
    """What of a chunk its best paths have to be known for, to tell where they come in: up to the first place that no piece crosses."""
    edges = cuts(text, 1, size)
    return text if edges is None else text[: edges[0]]


def origins(model: Unigram, head: str, size: int, reach: np.ndarray) -> np.ndarray:
    """The entry state that the best path to each exit state of a chunk comes from; head is head_of() the chunk, reach the
    scores of its entry states.  An exit state that no path reaches leads to state 0."""
    last = min(size, len(head))
    best, back = model.paths(head, starts(reach, len(head)), last)
    if len(head) < size:
        # All paths pass the end of the head.
        return np.full(len(reach), entry_of(back, last), np.int64)
    ends = range(size, min(size + len(reach), len(best)))
    return np.array([entry_of(back, e) if best[e] > NEVER else 0 for e in ends] + [0] * (len(reach) - len(ends)), np.int64)


def starts(reach: np.ndarray, most: int) -> dict[int, int]:
    return {i: x for i, x in enumerate(reach.tolist()) if x > NEVER and i <= most}


def entry_of(back: list[tuple[int, int]], at: int) -> int:
    while back[at][1] != -1:
        at = back[at][0]
    return at


def backtrace(model: Unigram, text: str, size: int, reach: np.ndarray, exit_state: int, middle: list[str] | None, edges: tuple[int, int] | None) -> tuple[int, bytes]:
    """(entry state, ids) of a chunk that ends in exit_state."""
    end = size + exit_state
    if edges is None:
        _, back = model.paths(text, starts(reach, size), size)
        entry = entry_of(back, end)
        return entry, ids_bytes(model.ids_back(text, back, entry, end))
    a, b = edges
    _, back = model.paths(text[:a], starts(reach, a), a)
    entry = entry_of(back, a)
    out = ids_bytes(model.ids_back(text[:a], back, entry, a)) + model.joined(middle)[1]
    _, back = model.paths(text[b:], {0: 0}, size - b)
    return entry, out + ids_bytes(model.ids_back(text[b:], back, 0, end - b))


def learned(model: Unigram, chunks: list[tuple[str, int]]):
    """(middle words, edges) of chunks (text, size), all their words learned together."""
    edges = [cuts(text, 1, size) for text, size in chunks]
    middles = [None if e is None else split_words(text[e[0] : e[1]]) for (text, _), e in zip(chunks, edges, strict=True)]
    model.learn(set().union(*(m for m in middles if m)))
    return list(zip(middles, edges, strict=True))


def ids_bytes(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


def encode_giants(texts: DataFrame, model_path: str, chunk: int, group: int, summed: bool = False) -> DataFrame:
    """(key, part, ids, source) of texts (key, text), by the scan; equal texts count once.  If summed, measured() of them.

    source is the SHA-256 of the stretch of text that the ids of a chunk stand for.
    """

    longest = Unigram(model_path).longest
    entered = np.full(longest, NEVER, np.int64)
    entered[0] = 0

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[bytes] = set()
        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if key in known:
                    continue
                if len(known) >= KNOWN_KEYS:
                    known.clear()
                known.add(key)
                text = text.as_py()
                rows = [(i // chunk, len(text[i : i + chunk]), text[i : i + chunk + longest - 1]) for i in range(0, len(text), chunk)]
                for at in range(0, len(rows), 64):
                    part = list(zip(*rows[at : at + 64], strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(part[0])), pa.array(part[0], pa.int64()), pa.array(part[1], pa.int64()), pa.array(part[2], pa.string())], names=["key", "part", "size", "text"])

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Unigram(model_path)
        for b in batches:
            for at in range(0, b.num_rows, TOGETHER):
                part = b.slice(at, TOGETHER)
                rows = list(zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True))
                found = pa.array([transfer(model, t, n).tobytes() for n, t in rows], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), found, pa.array([head_of(t, n) for n, t in rows], pa.string())], names=["key", "part", "size", "matrix", "head"])

    def arrays(t: pa.Table, column: str, a: int, e: int) -> list[np.ndarray]:
        return [np.frombuffer(x.as_buffer(), np.int64).reshape(longest, -1) for x in t.column(column).slice(a, e - a)]

    def rows_of(**columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    def vectors(found: Iterable[np.ndarray]) -> pa.Array:
        return pa.array([x.tobytes() for x in found], pa.binary())

    def combine(t: pa.Table, edges: np.ndarray) -> Iterator[pa.RecordBatch]:
        out = []
        for a, e in zip(edges[:-1], edges[1:], strict=True):
            ms = arrays(t, "matrix", a, e)
            while len(ms) > 1:
                ms = [product(ms[i], ms[i + 1]) if i + 1 < len(ms) else ms[i] for i in range(0, len(ms), 2)]
            out.append(ms[0])
        first = pa.array(edges[:-1])
        yield rows_of(key=t.column("key").chunk(0).take(first), g=t.column("g").chunk(0).take(first), matrix=vectors(out))

    def between_groups(t: pa.Table, edges: np.ndarray) -> Iterator[pa.RecordBatch]:
        found = [x for a, e in zip(edges[:-1], edges[1:], strict=True) for x in reached(arrays(t, "matrix", a, e), entered)]
        yield rows_of(key=t.column("key").chunk(0), g=t.column("g").chunk(0), enter=vectors(found))

    def within_group(t: pa.Table, edges: np.ndarray) -> Iterator[pa.RecordBatch]:
        model, size, head = Unigram(model_path), t.column("size").to_numpy(), t.column("head")
        reach, table = [], []
        for a, e in zip(edges[:-1], edges[1:], strict=True):
            found = reached(arrays(t, "matrix", a, e), np.frombuffer(t.column("enter")[int(a)].as_buffer(), np.int64))
            reach += found
            table += [origins(model, head[i].as_py(), int(size[i]), r) for i, r in zip(range(a, e), found, strict=True)]
        yield rows_of(key=t.column("key").chunk(0), part=t.column("part").chunk(0), g=t.column("g").chunk(0), reach=vectors(reach), table=vectors(table))

    def composed(t: pa.Table, edges: np.ndarray) -> Iterator[pa.RecordBatch]:
        """The table of each group: of its chunks' tables, the last first."""
        out = []
        for a, e in zip(edges[:-1], edges[1:], strict=True):
            at = np.arange(longest)
            for x in reversed(arrays(t, "table", a, e)):
                at = x[:, 0][at]
            out.append(at)
        first = pa.array(edges[:-1])
        yield rows_of(key=t.column("key").chunk(0).take(first), g=t.column("g").chunk(0).take(first), table=vectors(out))

    def leaving(t: pa.Table, edges: np.ndarray, exits) -> list[int]:
        """The state after each row, from that after the last row of its group."""
        out = []
        for n, (a, e) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            at, own = exits[n], []
            for x in reversed(arrays(t, "table", a, e)):
                own.append(at)
                at = int(x[at, 0])
            out += own[::-1]
        return out

    def after_groups(t: pa.Table, edges: np.ndarray) -> Iterator[pa.RecordBatch]:
        yield rows_of(key=t.column("key").chunk(0), g=t.column("g").chunk(0), leave=pa.array(leaving(t, edges, [0] * (len(edges) - 1)), pa.int64()))

    def after_chunks(t: pa.Table, edges: np.ndarray) -> Iterator[pa.RecordBatch]:
        found = leaving(t, edges, t.column("leave").to_numpy()[edges[:-1]].tolist())
        yield rows_of(key=t.column("key").chunk(0), part=t.column("part").chunk(0), reach=t.column("reach").chunk(0), exit=pa.array(found, pa.int64()))

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Unigram(model_path)
        for b in batches:
            for at in range(0, b.num_rows, TOGETHER):
                rows = b.slice(at, TOGETHER)
                parts, texts, sizes, leaves = (rows.column(i).to_pylist() for i in (1, 2, 3, 5))
                known = learned(model, list(zip(texts, sizes, strict=True)))
                ids, sources = [], []
                for part, text, size, reach, leave, k in zip(parts, texts, sizes, rows.column(4), leaves, known, strict=True):
                    entry, found = backtrace(model, text, size, np.frombuffer(reach.as_buffer(), np.int64), leave, *k)
                    ids.append(found)
                    sources.append(hashlib.sha256(text[entry : size + leave].replace(SPACE, " ")[part == 0 :].encode("utf-8", "surrogatepass")).digest())
                if summed:
                    yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), *measured(model, ids, parts, sources)], names=["key", "part", *MEASURED])
                else:
                    yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(ids, pa.binary()), pa.array(sources, pa.binary())], names=["key", "part", "ids", "source"])

    # Dealt by (key, part): the chunks of one text spread over all tasks.
    chunks = cut(texts.mapInArrow(split, "key binary, part long, size long, text string").groupBy("key", "part").agg(*(F.any_value(c).alias(c) for c in ("size", "text"))))
    steps = cut(chunks.mapInArrow(matrices, "key binary, part long, size long, matrix binary, head string").withColumn("g", F.expr(f"part div {group}")))
    whole = in_groups(steps.select("key", "g", "part", "matrix"), ["key", "g"], combine, "key binary, g long, matrix binary", ["part"])
    enter = in_groups(whole, ["key"], between_groups, "key binary, g long, enter binary", ["g"])
    tables = cut(in_groups(steps.join(enter, ["key", "g"]), ["key", "g"], within_group, "key binary, part long, g long, reach binary, table binary", ["part"]))
    groups = in_groups(tables.select("key", "g", "part", "table"), ["key", "g"], composed, "key binary, g long, table binary", ["part"])
    leave = in_groups(groups, ["key"], after_groups, "key binary, g long, leave long", ["g"])
    bounds = in_groups(tables.join(leave, ["key", "g"]), ["key", "g"], after_chunks, "key binary, part long, reach binary, exit long", ["part"])
    return chunks.join(bounds, ["key", "part"]).select("key", "part", "text", "size", "reach", "exit").mapInArrow(trace, f"key binary, part long, {MEASURED_SCHEMA if summed else 'ids binary, source binary'}")


def marked(rows: DataFrame) -> DataFrame:
    """(doc_id, text) with key (SHA-256 of the text) and space marks in the text."""
    with_marks = F.when(F.col("text") == "", "").otherwise(F.concat(F.lit(SPACE), F.replace("text", F.lit(" "), F.lit(SPACE))))
    return rows.select("doc_id", F.unhex(F.sha2("text", 256)).alias("key"), with_marks.alias("text"))


def texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text) with null as empty."""
    return df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def encode_whole(rows: DataFrame, model_path: str, summed: bool = False) -> DataFrame:
    """doc_id, key, part 0, ids of rows of marked() that one task encodes each; if summed, doc_id and measured() of the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Unigram(model_path)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                found = model.encode_all(part.column(2).to_pylist())
                if summed:
                    yield pa.RecordBatch.from_arrays([part.column(0), *measured(model, found, [0] * len(found), part.column(1).to_pylist())], names=["doc_id", *MEASURED])
                else:
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([0] * len(found), pa.int64()), pa.array(found, pa.binary())], names=["doc_id", "key", "part", "ids"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, {MEASURED_SCHEMA if summed else 'key binary, part long, ids binary'}")


def parts(df: DataFrame, id_col: str, text_col: str, model_path: str, chunk: int, group: int, summed: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Short rows encoded; the chunks of each distinct giant text by key; (doc_id, key) of the rows with a giant text.

    If summed, measured() stands in the place of ids.
    """
    rows = texts(df, id_col, text_col)
    # Lengths are asked of the stored text, before it is hashed and marked.
    giant = marked(rows.where(F.length("text") >= chunk))
    short = marked(rows.where(F.length("text") < chunk))
    return encode_whole(short, model_path, summed), encode_giants(giant.select("key", "text"), model_path, chunk, group, summed), giant.select("doc_id", "key")


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, model_path: str | None = None, chunk: int = CHUNK, group: int = GROUP) -> DataFrame:
    """One row per chunk of each row of df: doc_id, key (SHA-256 of the text), part, ids (little-endian unsigned 32-bit).

    A null or empty text has one row without ids.  Repeated rows and null ids have rows of their own; an empty table has
    none.  Characters outside the vocabulary become the ids of their UTF-8 bytes.
    """
    short, chunks, giant = parts(df, id_col, text_col, model_path or default_model(), chunk, group)
    return short.unionByName(giant.join(chunks, "key").select("doc_id", "key", "part", "ids"))


def decode(pieces: DataFrame, model_path: str | None = None) -> DataFrame:
    """pieces (with part and ids) and a column text: what the ids of each chunk stand for; a text is its chunks' texts joined in order."""
    model_path = model_path or default_model()
    names, kinds = pieces.columns, pieces.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Unigram(model_path)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                texts = [model.decode(np.frombuffer(i.as_buffer(), "<u4"), p == 0) for i, p in zip(part.column(names.index("ids")), part.column(names.index("part")).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*names, "text"])

    return pieces.mapInArrow(run, T.StructType([*kinds, T.StructField("text", T.StringType())]))


def id_hash(ids: np.ndarray) -> int:
    """Polynomial hash of ids modulo PRIME; that of joined sequences follows from theirs: h(a + b) = h(a) * BASE**len(b) + h(b)."""
    h = 0
    for i in range(0, len(ids), 1 << 15):
        part = ids[i : i + (1 << 15)].astype(np.int64) + 1
        h = (h * pow(BASE, len(part), PRIME) + int((part * POWERS[len(part) - 1 :: -1][: len(part)]).sum())) % PRIME
    return h


def measured(model: Unigram, ids: list[bytes], parts: list[int], sources: list[bytes]) -> list[pa.Array]:
    """MEASURED of pieces: whether decoding gives the text of source (a SHA-256) back, their number of ids, their hash.

    Worked out in the task that made the ids: a second Python stage behind it would hold the model, its words and the
    batches in a worker of its own beside the first one.
    """
    n, hashes, right = [], [], []
    for i, part, source in zip(ids, parts, sources, strict=True):
        found = np.frombuffer(i, "<u4")
        n.append(len(found))
        hashes.append(id_hash(found))
        right.append(hashlib.sha256(model.decode(found, part == 0).encode("utf-8", "surrogatepass")).digest() == source)
    return [pa.array(right, pa.bool_()), pa.array(n, pa.int64()), pa.array(hashes, pa.int64())]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def digest(df: DataFrame, model_path: str | None = None, chunk: int = CHUNK, group: int = GROUP) -> DataFrame:
    """doc_id, n_tokens, n_chunks, ids_hash and round_trip (decoding gives the text back) per row of df.

    Of the chunks of a giant text only their hashes are gathered.
    """
    model_path = model_path or default_model()
    short, chunks, giant = parts(df, "doc_id", "text", model_path, chunk, group, summed=True)
    one = short.select("doc_id", F.col("n").alias("n_tokens"), F.lit(1).cast("long").alias("n_chunks"), F.col("hash").alias("ids_hash"), F.col("right").alias("round_trip"))

    def join(t: pa.Table, edges: np.ndarray) -> Iterator[pa.RecordBatch]:
        n, x, right, hashes = t.column("n").to_pylist(), t.column("hash").to_pylist(), t.column("right").to_numpy(), []
        for a, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            h = 0
            for i in range(a, e):
                h = (h * pow(BASE, n[i], PRIME) + x[i]) % PRIME
            hashes.append(h)
        first = edges[:-1]
        columns = [t.column("key").chunk(0).take(pa.array(first)), pa.array(np.add.reduceat(np.array(n), first)), pa.array(np.diff(edges)), pa.array(hashes, pa.int64()), pa.array(np.logical_and.reduceat(right, first))]
        yield pa.RecordBatch.from_arrays(columns, names=["key", "n_tokens", "n_chunks", "ids_hash", "round_trip"])

    long = in_groups(chunks, ["key"], join, "key binary, n_tokens long, n_chunks long, ids_hash long, round_trip boolean", ["part"])
    return one.unionByName(joined(cut(giant), long, "key").drop("key"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
