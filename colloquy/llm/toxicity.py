"""Toxicity scores: a recurrent network over all overlapping windows of a text.

The network (``gru``) reads windows of ``LENGTH`` words, one from every word of a text that has
a whole window before its end.  Words are what white space separates, in lower case, with their marks.  A text's features
are its highest window logit, the mean of its three highest and the number of windows, and a logistic unit, fitted on
labelled texts that the network was not trained on, turns them into a probability under the labels' own share of toxic ones.

Fitting takes a bounded sample of labelled rows: of either label at most ``SAMPLE``, and no more than ``SAMPLE_BYTES``
of text, those whose ids have the least hashes.  Sampled texts are whole, and training draws from all of their windows.
Scoring covers every window of every text, in the task that reads it.

Nulls: a null or empty text is scored as a window without words; null ids and null labels are not learned.
A very long text is laid out by itself.  Equal texts have equal scores, whatever their ids.  Of rows with one
id the least text is learned; all are scored.  An empty table gives no rows.
"""

from __future__ import annotations

import pickle
from collections import defaultdict
from collections.abc import Iterable
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from colloquy.llm.common import Sent, arrow_map, cut_lineage, give_back, slices, table, utf8
from colloquy.llm.gru import Network, Words, sigmoid, train

LENGTH = 24
SAMPLE = 2_500
SAMPLE_BYTES = 8_000_000
EPOCHS = 24
CUT = 0.3

#: Words whose inputs a worker keeps, and windows in a pass through the network.
VOCABULARY = 150_000
PASS = 4_096
#: Bytes of text whose windows are laid out at once, if not of one longer text.
PART = 400_000


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row's label must not be learned: crc32 of its id as text leaves 2 on division by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def read_words(text: bytes | None) -> list[bytes]:
    """The text's words in lower case (A-Z), marks included."""
    return text.lower().split() if text else []


def numbers(words: Iterable[bytes] = ()) -> dict:
    """Numbers of words in the order of their first appearance, from 1; asking for a new word numbers it.  0 is padding."""
    known = dict(zip(chain([None], words), count()))
    return defaultdict(count(len(known)).__next__, known)  # a factory that held the table itself would outlive it until a collection


class Scorer:
    """Scores texts in a worker; keeps what the network needs of words it has met."""

    def __init__(self, network: Network):
        self.network = network
        self.known = numbers()
        self.gates = np.zeros_like(network.projected([b"a"]))  # what words bring to the gates; row 0, padding, brings nothing
        self.met = np.zeros(1, np.int32)

    def forget(self) -> None:
        """Keeps the words met most often, a quarter of the vocabulary at most: most words are met once only."""
        often = np.flatnonzero(self.met[1 : len(self.known)] > 1) + 1
        often = np.sort(often[np.argsort(-self.met[often], kind="stable")[: VOCABULARY // 4]])
        words = list(self.known)
        self.known = numbers(words[i] for i in often)
        for kept in (self.gates, self.met):
            kept[1 : len(often) + 1] = kept[often]
        self.met[1 : len(often) + 1] //= 2
        self.met[len(often) + 1 :] = 0

    def rows(self, texts: list[list[bytes]]) -> np.ndarray:
        """Rows of ``gates`` for the words of all texts; a text without words is one row of padding, row 0."""
        if len(self.known) > VOCABULARY:
            self.forget()
        known, before = self.known, len(self.known)
        found = np.fromiter(map(known.__getitem__, chain.from_iterable(t or [None] for t in texts)), np.int32)
        if len(known) > before:
            if len(known) > len(self.gates):  # room for as many again: a copy for each part would cost more than its words
                more = 2 * len(known) - len(self.gates)
                self.gates, self.met = np.pad(self.gates, ((0, more), (0, 0))), np.pad(self.met, (0, more))
            self.gates[before : len(known)] = self.network.projected(list(islice(known, before, None)))
        self.met[: len(known)] += np.bincount(found, minlength=len(known)).astype(np.int32)
        return found

    def features(self, texts: list[list[bytes]]) -> np.ndarray:
        """(highest window logit, mean of the three highest, log of the windows' number) of each text."""
        flat = self.rows(texts)
        lengths = np.array([len(t) or 1 for t in texts])
        base = np.cumsum(lengths) - lengths
        counts = np.maximum(1, lengths - LENGTH + 1)
        begins = np.cumsum(counts) - counts
        of = np.repeat(np.arange(len(texts)), counts)
        begin = np.arange(len(of)) + (base - begins)[of]
        size = np.minimum(lengths, LENGTH)[of]
        full = size == LENGTH
        logits = np.empty(len(of), np.float32)
        if full.any():
            every = np.empty(len(flat) - LENGTH + 1, np.float32)
            for part in slices(len(every), PASS):  # windows across two texts are not looked at
                inputs = np.ascontiguousarray(self.gates.take(flat[part.start : part.stop + LENGTH - 1], axis=0).T)
                every[part] = self.network.every_logit(inputs, LENGTH)
            logits[full] = every[begin[full]]
        where = np.flatnonzero(~full)
        for part in slices(len(where), PASS):
            chosen = where[part]
            steps = np.arange(LENGTH)[:, None]
            mask = steps < size[chosen]
            ids = np.where(mask, flat[np.minimum(begin[chosen] + steps, len(flat) - 1)], 0)
            logits[chosen] = self.network.logits(self.gates[ids], mask)
        top = []
        for i in range(3):
            best = np.maximum.reduceat(logits, begins)
            top.append(best if i == 0 else np.where(counts > i, best, top[-1]))
            at = np.flatnonzero(logits == best[of])  # of each text's best the first is taken out
            logits[at[np.flatnonzero(np.diff(of[at], prepend=-1))]] = -np.inf
        return np.stack([top[0], np.mean(top, axis=0), np.log(counts)], axis=1).astype(np.float64)


def parts(texts: list[bytes | None]) -> list[list[bytes | None]]:
    """The texts in lists of at most ``PART`` bytes, or of one text."""
    out: list[list[bytes | None]] = []
    size = PART + 1
    for text in texts:
        size += len(text or b"")
        if size > PART or len(out[-1]) == 400:
            out.append([])
            size = len(text or b"")
        out[-1].append(text)
    return out


class Calibrator:
    """Logistic unit over standardised features, with a ridge."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weights: np.ndarray, ridge: float = 1.0):
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        z = np.concatenate([np.ones((len(x), 1)), (x - self.mean) / self.scale], axis=1)
        self.beta = np.zeros(z.shape[1])
        penalty = np.diag([1e-3, *[ridge] * x.shape[1]])
        for _ in range(50):
            p = sigmoid(z @ self.beta)
            slope = z.T @ (weights * (y - p)) - penalty @ self.beta
            bend = (z * (weights * p * (1 - p))[:, None]).T @ z + penalty
            self.beta += np.linalg.solve(bend, slope)

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(sigmoid(self.beta[0] + ((x - self.mean) / self.scale) @ self.beta[1:]), 0, 1)


class Constant:
    """Stands in where there is nothing to learn: one of the labels is missing."""

    def __init__(self, share: float):
        self.share = share

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.share)


class Model:
    def __init__(self, network: Network, calibrator):
        self.network, self.calibrator = network, calibrator

    def scored(self, scorer: Scorer, texts: list[bytes | None]) -> np.ndarray:
        return self.calibrator.score(scorer.features([read_words(t) for t in texts]))


def sampled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, sample: int, sample_bytes: int) -> tuple[DataFrame, dict[int, int]]:
    """id, toxic and text of the labelled texts to learn from, and the labels' counts."""
    known = labels.where(F.col("toxic").isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(F.col(id_col).cast("string").alias("id")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    some = None
    for label in (0, 1):
        part = known.where(F.col("toxic") == label).orderBy(F.xxhash64("id"), "id").limit(sample)
        some = part if some is None else some.unionByName(part)
    # at most 2 * SAMPLE rows: the other side of the join stays where it is, and a repeated id gives one row
    texts = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).where("text is not null")
    found = cut_lineage(texts.join(F.broadcast(some), "id").groupBy("id", "toxic").agg(F.min("text").alias("text")))
    sizes = found.select("id", "toxic", F.octet_length("text").alias("size"), F.xxhash64("id").alias("hash")).collect()
    room, chosen = {0: sample_bytes, 1: sample_bytes}, []
    for r in sorted(sizes, key=lambda r: (r["hash"], r["id"])):
        if r["size"] <= room[r["toxic"]]:
            room[r["toxic"]] -= r["size"]
            chosen.append((r["id"],))
    chosen = docs.sparkSession.createDataFrame(chosen, "id string")
    return found.join(F.broadcast(chosen), "id").select("id", "toxic", "text"), counts


def trained(rows: pa.Table, seed: int, epochs: int) -> tuple[dict, list[str], dict[int, int]] | None:
    """The network's weights, the ids whose texts calibrate and the texts of either label; nothing without both labels."""
    rows = rows.sort_by("id").combine_chunks()
    texts = utf8(rows.column("text").combine_chunks())
    found = [(i, toxic, k) for k, (i, toxic) in enumerate(zip(rows.column("id").to_pylist(), rows.column("toxic").to_pylist(), strict=True)) if texts[k].split(None, 1)]
    y = np.array([x[1] for x in found])
    if len(found) == 0 or y.min() == y.max():
        return None
    place = np.empty(len(y), np.int64)  # within its label: every third text calibrates
    for k in (0, 1):
        place[y == k] = np.arange((y == k).sum())
    learn = place % 3 != 2
    if not (y[learn] == 1).any() or not (y[~learn] == 1).any():
        learn = np.ones(len(y), bool)
    network, vocabulary = Network(seed=seed), numbers()
    learned = [np.fromiter(map(vocabulary.__getitem__, read_words(texts[found[i][2]])), np.int32) - 1 for i in np.flatnonzero(learn)]
    words = Words(network, list(islice(vocabulary, 1, None)))
    del rows, texts, vocabulary  # training needs numbers alone, and takes longer than all else
    give_back()
    train(network, learned, words, y[learn].astype(np.float32), length=LENGTH, epochs=epochs)
    kept = np.arange(len(y)) if learn.all() else np.flatnonzero(~learn)
    return network.p, [found[i][0] for i in kept], {k: int((y == k).sum()) for k in (0, 1)}


def fit(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES, epochs: int = EPOCHS, seed: int = 1
) -> Model:
    """Learns from the rows of ``labels`` that are not held out, a null label counting as none.

    Repeated labels of a document count as toxic if one of them does.  With only one label to learn
    from, all texts score the share of toxic labels.  The network is trained in one task: the driver gets its weights, not the texts.
    """
    picked, counts = sampled(docs, labels, id_col, text_col, sample, sample_bytes)

    schema = pa.schema([("id", pa.string()), ("toxic", pa.int32()), ("text", pa.string())])

    def learn(batches):
        give_back()
        found = trained(pa.Table.from_batches((b.cast(schema) for b in batches), schema), seed, epochs)  # no name here holds the texts
        if found is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(found)], pa.binary())], names=["found"])

    told = picked.coalesce(1).mapInArrow(learn, "found binary").collect()
    network = Network(seed=seed)
    if not told:
        return Model(network, Constant(counts.get(1, 0) / max(1, sum(counts.values()))))
    network.p, calibrates, n = pickle.loads(told[0]["found"])
    calibrates = set(calibrates)
    weight = {k: counts.get(k, 1) / n[k] for k in (0, 1)}
    ids = Sent(picked.sparkSession, calibrates)
    sent = Sent(picked.sparkSession, network)
    scorer: list = []

    def scan(batch: pa.RecordBatch):
        if not scorer:
            scorer.append(Scorer(sent.value))
        mine = [i for i, x in enumerate(batch.column(0).to_pylist()) if x in ids.value]
        if mine:
            texts = utf8(batch.column(2))
            x = np.concatenate([scorer[0].features([read_words(t) for t in part]) for part in parts([texts[i] for i in mine])])
            toxic = [batch.column(1)[i].as_py() for i in mine]
            yield pa.RecordBatch.from_arrays([pa.array(toxic, pa.int32()), pa.array(list(x), pa.list_(pa.float64()))], names=["toxic", "x"])

    rows = sorted(arrow_map(picked, scan, "toxic int, x array<double>").collect())
    x, y2 = np.array([r["x"] for r in rows]), np.array([float(r["toxic"] > 0) for r in rows])
    weights = np.array([weight[int(v)] for v in y2])
    return Model(network, Calibrator(x, y2, weights / weights.mean()))


def score_toxicity(docs: DataFrame, model: Model, *, text_col: str = "text", cut: float = CUT) -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher: likelier toxic) and ``predicted`` (1 from ``cut`` on) added.

    Null and empty texts score as a window without words.  Columns with the added names are replaced.
    """
    docs = docs.drop("score", "predicted")
    sent = Sent(docs.sparkSession, model)
    at = docs.schema.names.index(text_col)
    scorer: list = []

    def scan(batch: pa.RecordBatch):
        if not scorer:
            scorer.append(Scorer(sent.value.network))
        for some in slices(batch.num_rows, 1000):
            rows = batch.slice(some.start, some.stop - some.start)
            scores = np.concatenate([sent.value.scored(scorer[0], part) for part in parts(utf8(rows.column(at)))])
            yield pa.RecordBatch.from_arrays(
                [*rows.columns, pa.array(scores, pa.float64()), pa.array((scores >= cut).astype(np.int32), pa.int32())],
                names=[*rows.schema.names, "score", "predicted"],
            )

    return arrow_map(docs, scan, StructType([*docs.schema.fields, *StructType.fromDDL("score double, predicted int").fields]))


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
