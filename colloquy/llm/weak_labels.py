"""Quality classifier from weak labels.

1. Heuristic labellers vote on each text: good (1), poor (-1) or nothing (0).
2. What is counted is how often each combination of votes occurs, in all documents: at most 3 to the
   power of their number, whatever the input.
3. Expectation-maximisation over these counts estimates the share of good texts and each labeller's
   rates of votes on good and on poor texts, without any true label.  That gives every combination a
   posterior.
4. A linear scorer over hashed features (words, word shapes, characters and their statistics) is trained on
   a bounded sample of texts with their posteriors, and scores every text whole.

The sample has at most ``SAMPLE`` different texts, those with the least hashes, each weighted by its number of
rows up to ``MOST``; the scorer's weights are fixed in size.  The texts become features in the tasks that hold
them, before the least are picked.

Nulls: a null or empty text is one without words, for votes and scores.  A very long text is one row like any other.
Ties: texts with one hash are one example; equal texts have equal scores.  Of an empty table nothing is learned
and every score is 0.5.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from colloquy.llm.common import Sent, arrow_map, cut_lineage, slices, table, utf8

SAMPLE = 6_000
MOST = 4  # rows that a text of the sample counts as
BUCKETS = 1 << 16
EPOCHS = 6
KEEP = 0.5

WORDS = r"[^ \t-\r]+"


def votes(text: Column) -> dict[str, Column]:
    """The labellers, each an expression over a text; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    n = F.length(text)
    words = F.regexp_count(text, F.lit(WORDS))
    share = lambda part: part / F.greatest(n, F.lit(1))
    left = lambda dropped: F.length(F.regexp_replace(text, dropped, ""))  # noqa: E731  characters, without an array of them
    n_letters = left(r"\P{L}+")
    letters = share(n_letters)
    marks = share(left(r"[\p{L}\p{N}\s.,;:!?'\"()-]+"))
    upper = left(r"\P{Lu}+") / F.greatest(n_letters, F.lit(1))
    digits = share(left(r"\P{N}+"))
    mean_word = left(r"[ \t-\r]+") / F.greatest(words, F.lit(1))
    stops = F.regexp_count(text, F.lit(r"(?<!\S)[.,]?(the|and|of|to|in|that|is|der|die|und|das|den|mit|le|la|les|des|et|que|el|los|de|en|y)[.,]?(?!\S)")) / F.greatest(words, F.lit(1))
    lines = F.split(text, "\n")
    n_lines = F.size(lines)
    distinct = F.size(F.array_distinct(lines)) / n_lines
    shouts = F.regexp_count(text, F.lit(r"!{2,}|\?{2,}|([#$%&*|=_~])\1|(?<!\S)\|(?!\S)")) / F.greatest(words, F.lit(1))
    echoes = F.regexp_count(text, F.lit(r"(?<!\S)(\S+)\s+(?=\1(?!\S))")) / F.greatest(words, F.lit(1))
    sentences = F.regexp_count(text, F.lit(r"[.!?](?=\s|$)")) / F.greatest(words, F.lit(1))

    def vote(good: Column, poor: Column) -> Column:
        return F.when(poor, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))

    return {
        "length": vote((words >= 30) & (words <= 20_000), words < 8),
        "letters": vote(letters >= 0.75, letters < 0.6),
        "marks": vote(marks < 0.005, marks > 0.03),
        "upper": vote(upper < 0.08, upper > 0.3),
        "digits": vote(digits < 0.01, digits > 0.1),
        "word_length": vote((mean_word > 3.5) & (mean_word < 9), (mean_word < 2.5) | (mean_word > 12)),
        "stop_words": vote(stops > 0.08, stops < 0.02),
        "repeats": vote((distinct > 0.95) & (n_lines >= 3), distinct < 0.6),
        "shouts": vote(shouts < 0.002, shouts > 0.05),
        "echoes": vote(echoes < 0.01, echoes > 0.2),
        "sentences": vote((sentences > 0.03) & (sentences < 0.25), sentences < 0.005),
    }


class VoteModel:
    """Rates of each labeller's votes on good and poor texts, by expectation-maximisation."""

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, rounds: int = 200, prior: float = 2.0):
        n, m = patterns.shape
        onehot = (patterns[:, :, None] == np.array([-1, 0, 1])).astype(float)
        # to begin with, labellers are right oftener than not
        balance = patterns.sum(axis=1) / m
        good = 1 / (1 + np.exp(-4 * balance))
        self.rates = np.empty((2, m, 3))
        for _ in range(rounds):
            weight = np.stack([counts * (1 - good), counts * good])
            totals = weight.sum(axis=1)
            self.share = (totals[1] + prior) / (totals.sum() + 2 * prior)
            pull = prior * np.array([[3.0, 2.0, 1.0], [1.0, 2.0, 3.0]])
            hits = np.einsum("kn,nmv->kmv", weight, onehot) + pull[:, None, :]
            self.rates = hits / hits.sum(axis=2, keepdims=True)
            new = self.posterior(patterns)
            if np.abs(new - good).max() < 1e-7:
                break
            good = new

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability that a text with these votes is good."""
        logs = np.log(self.rates)
        index = patterns + 1
        each = np.stack([logs[k][np.arange(patterns.shape[1])[None, :], index].sum(axis=1) for k in (0, 1)])
        odds = np.log(self.share / (1 - self.share)) + each[1] - each[0]
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


SHAPE = bytes(0x61 if 0x61 <= c <= 0x7A else 0x41 if 0x41 <= c <= 0x5A else 0x30 if 0x30 <= c <= 0x39 else 0xC3 if c >= 0x80 else c for c in range(256))
RUNS = re.compile(rb"(.)\1+", re.S)


class WordBuckets(dict):
    """Rows of ``table``, the buckets of a word's shape and of the word itself; words are kept between texts."""

    def __init__(self):
        self.table = np.empty((1 << 12, 2), np.int64)

    def __missing__(self, word: bytes) -> int:
        row = self[word] = len(self)
        if row == len(self.table):
            self.table = np.concatenate([self.table, np.empty_like(self.table)])
        shape = RUNS.sub(rb"\1", word.translate(SHAPE))
        self.table[row] = xxhash.xxh3_64_intdigest(shape, 1) % BUCKETS, xxhash.xxh3_64_intdigest(word, 2) % BUCKETS
        return row


class Features:
    """Hashed features of texts: shares of word shapes, words and characters."""

    def __init__(self):
        self.words = WordBuckets()

    def of(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(buckets, values) of a text; the buckets are distinct and the values have length 1."""
        words = text.split()
        n = max(1, len(words))
        if len(self.words) > 200_000:
            self.words = WordBuckets()
        rows = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
        flat = self.words.table[rows].ravel()
        chars = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
        seen = np.flatnonzero(chars)
        lines = text.split(b"\n")
        stats = [
            xxhash.xxh3_64_intdigest(b"%s:%d" % (name, int(value)), 3) % BUCKETS
            for name, value in ((b"words", np.log2(n)), (b"lines", np.log2(len(lines))), (b"distinct", 10 * len(set(lines)) / len(lines)), (b"mean", len(text) / n), (b"echoes", 10 * sum(map(bytes.__eq__, words, words[1:])) / n))
        ]
        buckets = np.concatenate([flat, seen * 251 % BUCKETS, stats, [0]])
        weights = np.concatenate([np.full(len(flat), 1.0 / n), np.sqrt(chars[seen] / max(1, len(text))), [0.5] * 5, [1.0]])
        keys, spot = np.unique(buckets, return_inverse=True)
        values = np.bincount(spot, weights=weights, minlength=len(keys))
        values = np.sqrt(values)
        return keys, values / np.sqrt((values**2).sum())


class Scorer:
    def __init__(self, weights: np.ndarray):
        self.weights = weights

    def score(self, found: tuple[np.ndarray, np.ndarray]) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.weights[found[0]] @ found[1], -30, 30))))


def train_scorer(examples: list[tuple[np.ndarray, np.ndarray]], posteriors: np.ndarray, counts: np.ndarray, epochs: int = EPOCHS, rate: float = 0.5, seed: int = 9) -> Scorer:
    """Logistic regression on soft labels by Adagrad; an example weighs as much as its count."""
    rng = np.random.default_rng(seed)
    weights, seen = np.zeros(BUCKETS), np.full(BUCKETS, 1e-3)
    for _ in range(epochs):
        for i in rng.permutation(len(examples)):
            keys, values = examples[i]
            slope = 1 / (1 + np.exp(-np.clip(weights[keys] @ values, -30, 30))) - posteriors[i]
            g = counts[i] * slope * values + 1e-5 * weights[keys]
            seen[keys] += g * g
            weights[keys] -= rate * g / np.sqrt(seen[keys])
    return Scorer(weights)


def fit_quality(docs: DataFrame, *, text_col: str = "text", sample: int = SAMPLE) -> tuple[VoteModel | None, Scorer]:
    """The vote model from all rows of ``docs``, and the scorer from a sample.  Of an empty table both know nothing."""
    spark = docs.sparkSession
    told = docs.select(F.col(text_col).alias("text"), *(v.cast("int").alias(k) for k, v in votes(F.col(text_col)).items()))
    names = told.columns[1:]
    rows = cut_lineage(told.groupBy(*names).agg(F.count("*").alias("n"))).collect()  # at most 3 ** 11 rows
    if not rows:
        return None, Scorer(np.zeros(BUCKETS))
    rows = sorted(rows)
    patterns = np.array([[r[c] for c in names] for r in rows])
    model = VoteModel(patterns, np.array([float(r["n"]) for r in rows]))
    n = sum(r["n"] for r in rows)
    code = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    place = F.pmod("code", F.lit(1 << 40))
    sent = Sent(spark, model)

    def scan(batch: pa.RecordBatch):
        features = Features()
        own = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3, batch.num_columns)], axis=1)
        found = [features.of(t or b"") for t in utf8(batch.column(0))]
        yield pa.RecordBatch.from_arrays(
            [batch.column(1), batch.column(2), pa.array(sent.value.posterior(own)), pa.array([k for k, _ in found], pa.list_(pa.int32())), pa.array([v for _, v in found], pa.list_(pa.float32()))],
            names=["code", "n", "good", "keys", "values"],
        )

    def least(share: float) -> pa.Table:
        """Of the texts whose hashes lie in this share of all, the ``sample`` least."""
        some = told.withColumn("code", code).where(place < int(share * (1 << 40)))
        some = some.groupBy("code").agg(F.first("text").alias("text"), F.least(F.count("*"), F.lit(MOST)).alias("n"), *(F.first(c).alias(c) for c in names))
        found = arrow_map(some.select("text", "code", "n", *names), scan, "code long, n long, good double, keys array<int>, values array<float>")
        return found.orderBy(place, "code").limit(sample).toArrow()

    share = min(1.0, 1.5 * sample / n)
    sampled = least(share)
    while sampled.num_rows < sample and share < 1:  # many copies: fewer texts than rows
        share = min(1.0, share * min(8.0, 1.5 * sample / max(1, sampled.num_rows)))
        sampled = least(share)
    keys, values = sampled.column("keys").combine_chunks(), sampled.column("values").combine_chunks()
    starts = np.asarray(keys.offsets)
    flat_k, flat_v = np.asarray(keys.values), np.asarray(values.values)
    examples = [(flat_k[a:b], flat_v[a:b]) for a, b in zip(starts[:-1], starts[1:], strict=True)]
    good = sampled.column("good").to_numpy()
    order = np.argsort(sampled.column("code").to_numpy())  # the same order wherever rows came from
    return model, train_scorer([examples[i] for i in order], good[order], sampled.column("n").to_numpy()[order])


def score_quality(docs: DataFrame, scorer: Scorer, *, text_col: str = "text", keep: float = KEEP) -> DataFrame:
    """``docs`` with ``quality`` (0 to 1) and ``kept`` (``quality`` reaches ``keep``) added.

    Null and empty texts score as a text without words.  Columns with the added names are replaced.
    """
    docs = docs.drop("quality", "kept")
    at = docs.schema.names.index(text_col)
    sent = Sent(docs.sparkSession, scorer)
    features = Features()

    def scan(batch: pa.RecordBatch):
        for part in slices(batch.num_rows, 1000):
            rows = batch.slice(part.start, part.stop - part.start)
            scores = [sent.value.score(features.of(t or b"")) for t in utf8(rows.column(at))]
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(scores, pa.float64()), pa.array([s >= keep for s in scores], pa.bool_())], names=[*rows.schema.names, "quality", "kept"])

    return arrow_map(docs, scan, StructType([*docs.schema.fields, *StructType.fromDDL("quality double, kept boolean").fields]))


def op10_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    _, scorer = fit_quality(docs)
    found = score_quality(docs, scorer)
    return found.select("doc_id", F.col("quality").alias("score"), F.col("kept").cast("int").alias("predicted"), F.col("kept").alias("keep"))
