"""Temperature mixing of sources to target weights.

A source's share of the tokens is raised to an exponent between 0 (all sources alike) and 1 (their
natural shares).  Entropy falls as the exponent grows, and so does the repetition of small sources, so
either target is met by bisection; a target entropy that would repeat some source more often than
allowed gives way to the repetition limit.

The weights become token budgets, and each source meets its budget by whole passes over its
documents and a part of one more.  A source is cut into ``BLOCKS`` blocks by a hash of its
rows; a pass takes them in a random order of its own, and the last pass stops at the block that
reaches the budget.  So a source's result differs from its budget by less than a block, and
what is windowed is at most ``BLOCKS`` rows a source, however large it is.  Blocks are told to the rows by
broadcast while their list is short (its length is checked), and by a shuffle beyond that.

Nulls: a null source is a source, a null or empty text has no words.  A very long text is one row.  Ties between
blocks are broken by their numbers; repeated rows share a block.  An empty table gives an empty mix.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.common import cut_lineage, table

BLOCKS = 1024
#: Of the largest entropy that the sources can have, the part that the mix should have.
EVENNESS = 0.95
MOST_PASSES = 4.0

#: Sources whose totals the driver holds; with more, each trial of the bisection is an aggregation.
DRIVER_SOURCES = 10_000
TRIALS = 48

#: Blocks in a list that is broadcast: some 15 MB, the blocks of 200 sources.
SHORT_LIST = 200_000


def token_count(text: Column) -> Column:
    """Words of a text, as a long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t-\r]+")), F.lit(0)).cast("long")


def bisect(holds: Callable[[float], bool], trials: int = TRIALS) -> float:
    """The largest exponent in [0, 1] for which ``holds``, which is true up to some point; 0 if none is."""
    if holds(1.0):
        return 1.0
    low, high = 0.0, 1.0
    for _ in range(trials):
        middle = (low + high) / 2
        low, high = (middle, high) if holds(middle) else (low, middle)
    return low


class Totals:
    """Sums over the sources' token totals, on the driver or, for very many sources, in Spark."""

    def __init__(self, totals: DataFrame):
        few = totals.select("tokens").limit(DRIVER_SOURCES + 1).collect()
        self.totals = totals
        self.local = sorted(r["tokens"] for r in few) if len(few) <= DRIVER_SOURCES else None
        if self.local is not None:
            self.n, self.all, self.least = len(self.local), sum(self.local), self.local[0] if self.local else 0
        else:
            self.n, self.all, self.least = totals.agg(F.count("*"), F.sum("tokens"), F.min("tokens")).first()

    def power(self, exponent: float) -> tuple[float, float]:
        """Sum of share ** exponent, and of the same times log(share ** exponent)."""
        if self.local is not None:
            x = [(t / self.all) ** exponent for t in self.local]
            return math.fsum(x), math.fsum(v * math.log(v) for v in x)
        x = F.pow(F.col("tokens") / F.lit(float(self.all)), F.lit(exponent))
        return tuple(self.totals.agg(F.sum(x), F.sum(x * F.log(x))).first())

    def entropy(self, exponent: float) -> float:
        total, logs = self.power(exponent)
        return math.log(total) - logs / total

    def passes(self, exponent: float, budget: float) -> float:
        """Over the smallest source, which is repeated most."""
        share = self.least / self.all
        return share**exponent / self.power(exponent)[0] * budget / self.least


def find_exponent(totals: Totals, budget: float, evenness: float, most_passes: float) -> float:
    """The exponent that meets the target entropy, or the nearest that keeps within the repetition limit.

    Where even natural shares repeat a source more often (the budget is too large), it is 1.
    """
    if totals.n < 2:
        return 1.0
    target = evenness * math.log(totals.n)
    exponent = bisect(lambda e: totals.entropy(e) >= target)
    if totals.passes(exponent, budget) <= most_passes:
        return exponent
    # fewer repeats with a larger exponent: the search runs down from 1
    return 1.0 - bisect(lambda e: totals.passes(1.0 - e, budget) <= most_passes)


def mix_sources(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    budget: float = 1.0,
    evenness: float = EVENNESS,
    most_passes: float = MOST_PASSES,
    blocks: int = BLOCKS,
    seed: int = 11,
) -> DataFrame:
    """The mix: rows of ``docs`` with ``n_tokens``, ``pass`` (from 0), ``block``, ``block_rank`` and ``weight`` added.

    ``budget`` is in multiples of the input's tokens.  Rows appear once for each pass that takes their block.
    A null source is a source like any other.  Rows without words have no weight and stay, once, with
    their block in pass 0 (and no rank, where the budget leaves the block out); so does a source without any words.  Repeated rows are rows each.  Of an empty
    table the mix is empty.  Columns of ``docs`` with the added names are replaced.
    """
    added = ["n_tokens", "pass", "block", "block_rank", "weight"]
    docs = docs.drop(*added)
    code = F.xxhash64(F.lit(seed), F.col(id_col).cast("string"), F.col(text_col))
    cut = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
        token_count(F.col(text_col)).alias("n_tokens"),
        F.pmod(code, F.lit(blocks)).cast("int").alias("block"),
        F.col(source_col).alias("_source"),
    )
    sums = cut_lineage(cut.groupBy("_source", "block").agg(F.sum("n_tokens").alias("tokens")))
    totals = cut_lineage(sums.groupBy("_source").agg(F.sum("tokens").alias("tokens")))
    full = Totals(totals.where("tokens > 0"))
    goal = budget * (full.all or 0)
    exponent = find_exponent(full, goal, evenness, most_passes)
    norm = full.power(exponent)[0] if full.n else 1.0

    share = F.col("total") / F.lit(float(full.all or 1))
    weighted = totals.select("_source", F.col("tokens").alias("total"))
    weighted = weighted.withColumn("weight", F.when(F.col("total") > 0, F.pow(share, F.lit(exponent)) / F.lit(norm)).otherwise(F.lit(0.0)))
    weighted = weighted.withColumn("quota", F.floor(F.col("weight") * F.lit(float(goal))))
    weighted = weighted.withColumn("whole", F.when(F.col("total") > 0, F.floor(F.col("quota") / F.col("total"))).otherwise(F.lit(1)).cast("int"))
    weighted = weighted.withColumn("rest", F.when(F.col("total") > 0, F.col("quota") - F.col("whole") * F.col("total")).otherwise(F.lit(0)).cast("long"))
    weighted = weighted.withColumnRenamed("_source", "_of")

    same = F.col("_source").eqNullSafe(F.col("_of"))
    placed = sums.join(weighted, same).drop("_of")
    order = lambda n: F.xxhash64(F.lit(seed), F.col("_source"), n, F.col("block"))
    last = Window.partitionBy("_source").orderBy(order(F.col("whole")), "block")
    placed = placed.withColumns({"before": F.sum("tokens").over(last) - F.col("tokens"), "last_rank": F.row_number().over(last) - 1})
    in_last = (F.col("before") < F.col("rest")) | ((F.col("tokens") == 0) & (F.col("whole") == 0))
    passes = F.when(in_last, F.col("whole") + 1).otherwise(F.col("whole"))
    taken = placed.where(passes > 0).select(F.col("_source").alias("_of"), F.col("block").alias("_block"), "weight", "whole", "last_rank", passes.alias("passes"))
    taken = cut_lineage(taken)
    if taken.count() <= SHORT_LIST:  # then no text moves
        taken = F.broadcast(taken)
    joined = cut.join(taken, same & (F.col("block") == F.col("_block")), "left").where("n_tokens = 0 or passes > 0")
    # a row without words is in its block's first pass only
    joined = joined.withColumn("passes", F.when(F.col("n_tokens") == 0, F.lit(1)).otherwise(F.col("passes")))
    dealt = joined.withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("passes").cast("int") - 1)))
    rank = F.when(F.col("pass") == F.col("whole"), F.col("last_rank").cast("long")).otherwise(order(F.col("pass")))
    return dealt.withColumns({"block_rank": rank.cast("long"), "weight": F.coalesce("weight", F.lit(0.0))}).select("row.*", *added)


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    found = mix_sources(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return found.select("doc_id", "source", "n_tokens", "pass", "block", "block_rank", F.round("weight", 9).alias("weight"))
