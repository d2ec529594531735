"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies are counted over every training document.  The classifier is fitted with follow-the-regularised-
leader (per-coordinate, L1 + L2) on a bounded, per-language sample, then a temperature is fitted on a part of the sample
that the weights have not seen.  Term frequencies are relative, so a document's scores are a mean over its n-grams of
rows of one (features x languages) matrix: whole texts are scored by table look-ups, whatever their length.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ORDERS = (1, 2, 3)
BITS = 16
#: Rows the classifier is fitted on, shared out evenly over the languages.
SAMPLE = 3000
MAX_LANGUAGES = 256
EPOCHS, ALPHA, BETA, L1, L2 = 4, 2.0, 0.1, 1e-5, 1e-6
#: Texts are worked on in groups of about so many characters.
BLOCK = 1 << 18
UNKNOWN = "und"
#: Below this calibrated probability a filter rejects a text. Low, as texts in two languages at once are worth keeping.
MIN_SCORE = 0.35
_P = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def letters(text: str) -> np.ndarray:
    """Code points of the lower-cased text with every run of characters that aren't letters as one space, and a space at each end."""
    return np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), "<u4")


class Alphabet:
    """Which code points are letters, filled as they occur."""

    def __init__(self):
        self.known = np.zeros(0x110000, bool)
        self.letter = np.zeros(0x110000, bool)

    def clean(self, points: np.ndarray) -> np.ndarray:
        if not self.known[points].all():
            new = np.unique(points[~self.known[points]])
            self.letter[new] = [chr(c).isalpha() for c in new.tolist()]
            self.known[new] = True
        keep = self.letter[points]
        out = np.where(keep, points, 32)
        stay = keep.copy()
        stay[0] = True
        stay[1:] |= keep[:-1]
        return out[stay].astype(np.uint64)


def grams(points: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """For each order the feature of the n-gram that starts at each position (the last positions have none)."""
    out = []
    for n in ORDERS:
        if len(points) >= n:
            h = np.full(len(points) - n + 1, n, np.uint64)
            for i in range(n):
                h = (h ^ points[i : i + len(h)]) * _P[i]
                h ^= h >> np.uint64(29)
            out.append((n, ((h * _P[0]) >> np.uint64(64 - BITS)).astype(np.int64)))
    return out


@dataclass(frozen=True)
class Model:
    """weights: idf x coefficient, (features x languages); bias by language."""

    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def predict(self, texts: list[str | None], alphabet: Alphabet) -> tuple[list[str], np.ndarray]:
        total, names, scores = np.zeros((len(texts), len(self.languages))), [UNKNOWN] * len(texts), np.zeros(len(texts))
        counted = np.zeros(len(texts), np.int64)
        at = 0
        while at < len(texts):
            block, owner, size, first = [], [], 0, at
            while at < len(texts) and (size < BLOCK or at == first):
                if texts[at]:
                    p = alphabet.clean(letters(texts[at]))
                    if len(p) > 1 and (p != 32).any():
                        block.append(p)
                        owner.append(at)
                        size += len(p)
                at += 1
            if not block:
                continue
            points, starts = np.concatenate(block), np.cumsum([0, *map(len, block)])
            for n, features in grams(points):
                # n-grams that would reach into the next text are left out.
                inside = np.ones(len(features), bool)
                for k in range(1, n):
                    edge = starts[1:] - k
                    inside[edge[(edge >= 0) & (edge < len(inside))]] = False
                doc = np.repeat(np.array(owner), np.diff(starts))[: len(features)]
                features, doc = features[inside], doc[inside]
                edges = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, int)
                for j in range(len(self.languages) if len(doc) else 0):
                    total[doc[edges], j] += np.add.reduceat(self.weights[features, j], edges, dtype=np.float64)
                if len(doc):
                    counted[doc[edges]] += np.diff(np.r_[edges, len(doc)])
        some = counted > 0
        if some.any():
            z = (total[some] / counted[some][:, None] + self.bias) / self.temperature
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            best = p.argmax(1)
            scores[some] = p[np.arange(len(p)), best]
            for i, b in zip(np.flatnonzero(some), best, strict=True):
                names[i] = self.languages[b]
        return names, scores


def features_of(text: str | None, alphabet: Alphabet) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of a text and their relative frequencies."""
    if not text:
        return np.zeros(0, np.int64), np.zeros(0)
    parts = [g for _, g in grams(alphabet.clean(letters(text)))]
    every = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    counts = np.bincount(every, minlength=1)
    where = np.flatnonzero(counts)
    return where, counts[where] / max(len(every), 1)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], idf: np.ndarray, n_languages: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and bias by FTRL-proximal; the bias is a coordinate of its own without penalties."""
    z, n = np.zeros((len(idf) + 1, n_languages)), np.zeros((len(idf) + 1, n_languages))
    one = np.array([len(idf)])

    def solve(at: np.ndarray) -> np.ndarray:
        l1, l2 = np.where(at < len(idf), L1, 0.0)[:, None], np.where(at < len(idf), L2, 0.0)[:, None]
        return np.where(np.abs(z[at]) > l1, -(z[at] - np.sign(z[at]) * l1) / ((BETA + np.sqrt(n[at])) / ALPHA + l2), 0.0)

    order = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for i in order.permutation(len(rows)):
            where, tf, label = rows[i]
            at, x = np.r_[where, one], np.r_[tf * idf[where], 0.1]
            w = solve(at)
            g = softmax(x @ w)
            g[label] -= 1
            g = x[:, None] * g
            grown = n[at] + g * g
            z[at] += g - (np.sqrt(grown) - np.sqrt(n[at])) / ALPHA * w
            n[at] = grown
    w = solve(np.arange(len(idf) + 1))
    return w[:-1], w[-1] * 0.1


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search on its logarithm."""
    if not len(labels):
        return 1.0
    loss = lambda t: -np.mean(np.log(softmax(logits / np.exp(t))[np.arange(len(labels)), labels] + 1e-12))
    a, b, r = -4.0, 4.0, (5**0.5 - 1) / 2
    for _ in range(60):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def train(labelled: DataFrame, sample: int = SAMPLE, max_languages: int = MAX_LANGUAGES) -> Model | None:
    """From rows (doc_id, text, lang); None if no language has a text with letters.

    Document frequencies and language counts cover all rows.  The sample takes, of each language, the rows of smallest
    hash; its features, at most 2**BITS numbers a row, come to one task.  More than max_languages languages raise
    ValueError.  Rows without text or lang are ignored.
    """
    rows = labelled.where("text IS NOT NULL AND lang IS NOT NULL").select("doc_id", "text", "lang")
    held = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(max_languages + 1).collect()}
    if len(held) > max_languages:
        raise ValueError(f"more than {max_languages} languages; max_languages sets the bound, as weights take 2**{BITS} numbers a language on the driver and in each worker")
    if not held:
        return None

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alphabet, df, docs = Alphabet(), np.zeros(1 << BITS, np.int64), 0
        for b in batches:
            for text in b.column(0):
                seen = np.zeros(1 << BITS, bool)
                for _, g in grams(alphabet.clean(letters(text.as_py()))):
                    seen[g] = True
                df += seen
                docs += 1
        where = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[where, -1]), pa.array(np.r_[df[where], docs])], names=["feature", "n"])

    counts = rows.select("text").mapInArrow(frequencies, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).toPandas().set_index("feature")["n"]
    total = int(counts.get(-1, 0))
    idf = np.zeros(1 << BITS)
    known = counts[counts.index >= 0]
    idf[known.index.to_numpy(np.int64)] = np.log((1 + total) / (1 + known.to_numpy())) + 1

    share = max(1, sample // len(held))
    # A hash below the language's threshold is expected on twice its share of rows, so few rows are sorted.
    most = F.create_map(*(F.lit(x) for lang, n in held.items() for x in (lang, min(1.0, (2.0 * share + 64) / n))))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(41)), F.lit(1 << 30)) / float(1 << 30)
    few = rows.withColumn("draw", draw).where(F.col("draw") < most[F.col("lang")])
    few = few.selectExpr("*", "row_number() OVER (PARTITION BY lang ORDER BY draw, doc_id, text) AS place").where(F.col("place") <= share)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alphabet = Alphabet()
        for b in batches:
            found = [features_of(t, alphabet) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([w.tolist() for w, _ in found], pa.list_(pa.int32())), pa.array([x.tolist() for _, x in found], pa.list_(pa.float32())), b.column(2)], names=["lang", "features", "tf", "place"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taken = [t for t in map(pa.RecordBatch.to_pandas, batches) if len(t)]
        model = fitted(pd.concat(taken), idf) if taken else None
        parts = model and (model.languages, model.weights, model.bias, model.temperature)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(parts)], pa.binary())], names=["model"])

    # One task fits the weights, so that the sample and what the fit works with take none of the driver's memory.
    taken = few.select("lang", "text", F.col("place").cast("long").alias("place")).mapInArrow(extract, "lang string, features array<int>, tf array<float>, place long")
    parts = pickle.loads(taken.repartition(1).mapInArrow(fit, "model binary").first()["model"])
    return parts and Model(*parts)


def fitted(taken: pd.DataFrame, idf: np.ndarray) -> Model | None:
    """The model of a sample (lang, features, tf, place); None if no text of it has a letter."""
    taken = taken[taken["features"].map(len) > 0].sort_values(["lang", "place"])
    if taken.empty:
        return None
    languages = sorted(taken["lang"].unique())
    number = {x: i for i, x in enumerate(languages)}
    data = [(np.asarray(f, np.int64), np.asarray(x, np.float64), number[lang]) for f, x, lang in zip(taken["features"], taken["tf"], taken["lang"], strict=True)]
    held_back = (taken["place"] % 5 == 0).to_numpy()
    fit = [r for r, h in zip(data, held_back, strict=True) if not h] or data
    check = [r for r, h in zip(data, held_back, strict=True) if h]
    w, bias = ftrl(fit, idf, len(languages))
    logits = np.array([(x * idf[f]) @ w[f] + bias for f, x, _ in check]).reshape(len(check), len(languages))
    return Model(languages, np.asfortranarray((w * idf[:, None]).astype(np.float32)), bias, temperature(logits, np.array([y for *_, y in check], int)))


def predict(df: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """payload (a struct of all columns of df), lang_pred, score per row; und and 0 for texts that are null or have no letter, and when there is no model."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alphabet, held = Alphabet(), shared.value
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = part.column(1).to_pylist()
                names, scores = held.predict(texts, alphabet) if held else ([UNKNOWN] * len(texts), np.zeros(len(texts)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["payload", "lang_pred", "score"])

    rows = df.select(F.struct(*(df[c] for c in df.columns)).alias("payload"), df[text_col].alias("text"))
    return rows.mapInArrow(run, T.StructType([rows.schema["payload"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def accepted(df: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of df (doc_id, text, lang and any others) whose language is recognised with at least min_score."""
    found = predict(df, train(df.where(F.col("doc_id").isNotNull() & ~held_out())))
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min_score)).select("payload.*")


def held_out(id_col: str = "doc_id") -> F.Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def identify(df: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score per row of df (doc_id, text, lang).

    Learns from rows with an id, a text and a lang that are not held out.  Repeated rows are predicted alike; an empty
    table gives no rows; without anything to learn from every row is und.
    """
    model = train(df.where(F.col("doc_id").isNotNull() & ~held_out()))
    found = predict(df.select("doc_id", "text"), model)
    return found.select("payload.doc_id", held_out("payload.doc_id").alias("held_out"), "lang_pred", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang"))
