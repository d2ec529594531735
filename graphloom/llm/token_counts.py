"""Token counts by dynamic programming that a trie of pre-tokens shares.

The distinct pre-tokens of a task go into tries.  The best unigram score of a prefix depends on the prefix alone, so it
and its number of pieces are computed once per trie node, from the nodes above, level by level; a pre-token's count
stands at its last node.  A text's count is the sum over its pre-tokens.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sentencepiece_scan import default_model, marked, texts
from .unigram import LONG_WORD, TOGETHER, PrefixTrie, Unigram, iter_words, split_words

#: Pre-tokens of a text that are counted together.
BLOCK = 1 << 18
#: Terminal counts after which a task forgets them (a memory bound: results do not depend on it).
TERMINALS = 400_000


class Terminals(dict):
    """Pre-token: number of tokens."""

    def __init__(self, model: Unigram):
        super().__init__()
        self.model = model

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self]
        if len(self) + len(new) > TERMINALS:
            self.clear()
            new = list(words)
        short = sorted(w for w in new if len(w) <= LONG_WORD)
        for at in range(0, len(short), TOGETHER):
            part = short[at : at + TOGETHER]
            self.update(zip(part, PrefixTrie(self.model, part).counts().tolist(), strict=True))
        # A pre-token of great length shares no long prefix worth keeping: the same recurrence over its last places only.
        self.update((w, self.model.count(w)) for w in new if len(w) > LONG_WORD)

    def count(self, text: str) -> tuple[int, int]:
        """Numbers of pre-tokens and tokens of a giant text, a block at a time."""
        n = tokens = 0
        words = iter_words(text)
        while block := list(islice(words, BLOCK)):
            self.learn(set(block))
            n, tokens = n + len(block), tokens + sum(map(self.__getitem__, block))
        return n, tokens


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str | None = None) -> DataFrame:
    """doc_id, n_chars, n_pretokens, n_tokens per row of df.

    A null or empty text has none.  A giant text is counted in blocks of pre-tokens, and a giant pre-token in memory that does
    not grow with it.  Repeated rows count alike, null ids stay null; an empty table gives no rows.
    """
    model_path = model_path or default_model()
    rows = marked(texts(df, id_col, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            held = held if held is not None else Terminals(Unigram(model_path))
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                texts = part.column(1).to_pylist()
                words = [split_words(t) if len(t) <= BLOCK else [] for t in texts]
                held.learn(set().union(*words))
                found = [(len(w), sum(map(held.__getitem__, w))) for w in words]
                found = [held.count(t) if len(t) > BLOCK else f for t, f in zip(texts, found, strict=True)]
                pretokens, tokens = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(pretokens, pa.int64()), pa.array(tokens, pa.int64())], names=["doc_id", "n_chars", "n_pretokens", "n_tokens"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    size = F.greatest(F.length("text") - 1, F.lit(0)).cast("long").alias("n_chars")
    return rows.select("doc_id", "text", size).mapInArrow(run, f"doc_id {kind}, n_chars long, n_pretokens long, n_tokens long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
