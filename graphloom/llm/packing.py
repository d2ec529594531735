"""Sum-of-squares online packing of documents into sequences of a fixed window.

Every task packs the documents of its partition: whole windows are cut off a document first; the remainder goes to the
fill level that minimises the sum over levels of (number of open windows at that level) squared, which one array of
counts by level tracks.  While the array has room, remainders stay whole and may open windows.  A full array, and the end
of a task, take no new window: the same rule then also looks at levels where a remainder does not fit, at which it is cut
to close the window and its rest stands at the level that is left over.  So memory is bounded for any distribution of
lengths, and every sequence but a task's last is closed by the rule; that one ends in powers of two, which need no padding.
No shuffle takes place, and a task that is run again gives the same rows.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WINDOW = 1024
#: Windows that the level array of a task holds: a bound of its memory (16 MB), as windows of equal fills may never close.
OPEN_WINDOWS = 4096
END = 0
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
#: Letters and marks whose classes all regex engines agree on; other texts take the library's own path.
_COMMON = re.compile("[^\x00-ɏ‐-‧€]")


class Encoder:
    """ids of byte_bpe_50k.json; for common scripts through the same vocabulary's faster ranks file."""

    def __init__(self, json_path: str, ranks_path: str | None, pattern: str | None):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(json_path)
        self.slow.encode_special_tokens = True
        self.fast = None
        if ranks_path and pattern:
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is not None and not _COMMON.search(text):
            return np.array([*self.fast.encode_ordinary(text), END], "<u4")
        return np.array([*self.slow.encode(text, add_special_tokens=False).ids, END], "<u4")


class SumOfSquares:
    """Packs pieces (doc, start, ids, doc_tokens) of at most a window; done holds the closed sequences as lists of pieces."""

    def __init__(self, window: int = WINDOW, capacity: int = OPEN_WINDOWS):
        self.window, self.capacity = window, capacity
        #: Open windows by level; those without ids are not counted, so the first entry stays 0.
        self.count = np.zeros(window, np.int64)
        self.open: list[list[list]] = [[] for _ in range(window)]
        self.n_open = 0
        self.done: list[list] = []

    def add(self, doc, ids: np.ndarray) -> None:
        n, w = len(ids), self.window
        whole = n - n % w
        self.done += [[(doc, a, ids[a : a + w], n)] for a in range(0, whole, w)]
        if n > whole:
            self.place([(doc, whole, ids[whole:], n)], n - whole, self.n_open < self.capacity)

    def level_for(self, size: int, room: bool) -> int:
        """The level at which size more ids leave the least sum of squares; 0 for a new window, which there is only with room.
        Of equal levels the lowest counts."""
        w, count = self.window, self.count
        # A window moves from its level to the one size further on, past the end with what is left of size.
        after = np.concatenate([count[size:], count[:size]])
        change = 2 * (after - count) + 2
        change[w - size] -= 1  # full windows leave the array
        usable = count > 0
        if room:
            usable[w - size + 1 :] = False
            usable[0], change[0] = True, 2 * count[size] + 1
        return int(np.where(usable, change, np.iinfo(np.int64).max).argmin())

    def place(self, pieces: list[tuple], size: int, room: bool) -> None:
        level, w = self.level_for(size, room) if room or self.n_open else 0, self.window
        held = self.taken(level) if level else []
        if level + size <= w:
            self.put(held + pieces, level + size)
            return
        first, rest = split(pieces, w - level)
        self.put(held + first, w)
        self.put(rest, level + size - w)

    def taken(self, level: int) -> list:
        self.count[level] -= 1
        self.n_open -= 1
        return self.open[level].pop()

    def put(self, held: list[tuple], level: int) -> None:
        if level == self.window:
            self.done.append(held)
            return
        self.open[level].append(held)
        self.count[level] += 1
        self.n_open += 1

    def finish(self) -> None:
        """Closes all windows: the emptiest one is placed again, until one is left, which ends in powers of two."""
        while self.n_open > 1:
            level = int(np.flatnonzero(self.count)[0])
            self.place(self.taken(level), level, False)
        if self.n_open:
            fill = int(np.flatnonzero(self.count)[0])
            held = self.taken(fill)
            while fill:
                size = 1 << (fill.bit_length() - 1)
                first, held = split(held, size)
                self.done.append(first)
                fill -= size


def split(pieces: list[tuple], size: int) -> tuple[list[tuple], list[tuple]]:
    """The first size ids of pieces, and the others."""
    first: list[tuple] = []
    for n, (doc, start, ids, total) in enumerate(pieces):
        if len(ids) > size:
            if size:
                first.append((doc, start, ids[:size], total))
            return first, [(doc, start + size, ids[size:], total), *pieces[n + 1 :]]
        first.append(pieces[n])
        size -= len(ids)
    return first, []


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, tokenizer: str | None = None, ranks: str | None = None, pattern: str | None = None, window: int = WINDOW) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    A null or empty text gives its end id alone.  Repeated rows are packed as often as they occur; a null id stays null.
    An empty table gives no rows.  sequence_id holds the task's partition above bit 33.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer, ranks, pattern = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer, made = None, SumOfSquares(window), TaskContext.get().partitionId() << 33

        def closed(least: int) -> Iterator[pa.RecordBatch]:
            nonlocal made
            if len(packer.done) <= least:
                return
            rows = []
            for sequence in packer.done:
                at = 0
                for doc, start, ids, n in sequence:
                    rows.append((doc, start, len(ids), ids.tobytes(), n, made, at))
                    at += len(ids)
                made += 1
            packer.done = []
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

        for b in batches:
            encode = encode or Encoder(tokenizer, ranks, pattern)
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                packer.add(doc, encode(text.as_py() or ""))
                yield from closed(1000)
        packer.finish()
        yield from closed(0)

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(pack(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
