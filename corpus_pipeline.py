"""A corpus pipeline: toxicity, near duplicates, repeated passages, benchmark passages, mix.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm import decontaminate as decontamination
from colloquy.llm import jaccard_join, mixing, substring_dedup
from colloquy.llm import toxicity as toxic
from colloquy.llm.common import cut_lineage, doc_key, remove_at_exit, shared_folder, table, text_key


def packed(docs: DataFrame, *needed: str) -> DataFrame:
    """The columns that a stage needs, and all others in one, so that none clashes with an operator's."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in needed]
    return docs.select(*needed, F.struct(F.lit(0).alias("_"), *rest).alias("__rest"))


def unpacked(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` again, in their order: those needed as they are now, the others as they were."""
    rest = found.schema["__rest"].dataType.names
    return found.select(*(F.col(f"__rest.`{c}`").alias(c) if c in rest else F.col(c) for c in docs.columns))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the cut.

    Null and empty texts are scored as texts without words; very long ones by all of their windows.  Equal texts
    have equal scores, so that repeated rows stay or go together.  An empty table stays empty; without labels of
    both kinds the share of toxic labels decides for all.
    """
    model = toxic.fit(docs, table(spark, sf_dir, "labels"))
    return unpacked(toxic.score_toxicity(packed(docs, "text"), model).where("predicted = 0"), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links connect, the row with the least id (one of them, if several are equal).

    A text without words, null or empty or blank, links to nothing, so every row that has one stays.  A row without an id
    counts as the largest id; of rows with one id and different texts the one with the least hash stays.  Very long texts
    count whole.  An empty table stays empty.
    """
    classes = jaccard_join.jaccard_classes(docs.select("doc_id", "text"))
    kept = classes.where("doc = class_id and text_code = class_text")
    kept = cut_lineage(kept.groupBy("doc", "text_code").agg(F.count("*").alias("n")))
    keyed = packed(docs, "doc_id", "text").withColumns({"__doc": doc_key(), "__text_code": text_key()})
    found = keyed.join(kept.select(F.col("doc").alias("__doc"), F.col("text_code").alias("__text_code")), ["__doc", "__text_code"], "left_semi")
    if kept.where("n > 1").limit(1).count():
        wordless = F.coalesce(F.col("text"), F.lit("")).rlike(r"^[ \t-\r]*$")
        found = found.where(wordless).unionByName(found.where(~wordless).dropDuplicates(["__doc", "__text_code"]))
    return unpacked(found, docs)


def substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that earlier documents have; a text of nothing else goes.

    Null, empty and short texts have no passage and stay as they are; very long ones count whole.  Rows of one id, and
    repeated rows of it, are none the earlier.  ``n_chars`` follows a changed text.  An empty table stays empty.
    """
    found = substring_dedup.remove_repeats(packed(docs, "doc_id", "text", "n_chars")).where("n_words = 0 or n_removed < n_words")
    changed = F.col("n_removed") > 0
    text = F.when(changed, F.col("kept_text")).otherwise(F.col("text"))
    found = found.withColumn("text", text).withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return unpacked(found, docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of the benchmark, whether or not its items have ids.

    Null and empty texts have no words and stay; very long ones are searched whole.  Repeated rows stay or go together.  An
    empty table stays empty, and with an empty benchmark all stay.
    """
    benchmark = table(spark, sf_dir, "benchmark").withColumn("item_id", F.coalesce(F.col("item_id").cast("string"), F.lit("")))
    found = decontamination.find_contamination(packed(docs, "text"), benchmark)
    return unpacked(found.where(F.size("spans") == 0), docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The budgeted mix of sources, a row for each time a document is taken, with n_tokens, pass, block and block_rank.

    A null source is a source.  Rows with null or empty texts weigh nothing and stay once.  Repeated rows lie in one
    block and are rows each.  Columns of ``docs`` with the added names are kept under them, and the added one is left out.
    An empty table stays empty.
    """
    found = mixing.mix_sources(packed(docs, "doc_id", "source", "text")).drop("weight")
    added = [c for c in ("n_tokens", "pass", "block", "block_rank") if c not in docs.columns]
    rest = found.schema["__rest"].dataType.names
    return found.select(*(F.col(f"__rest.`{c}`").alias(c) if c in rest else F.col(c) for c in docs.columns), *added)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring),
    ("decontaminate", decontaminate),
    ("mix", mix),
]

#: The first stage is a trained network, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = remove_at_exit(spark, shared_folder(spark, "pipeline"))
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
