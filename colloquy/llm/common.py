"""Helpers that several operators share."""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: The id that a row without an id takes in comparisons: it comes after every other.
NO_ID = 2**63 - 1

#: Entries a worker keeps of its word-to-code table before it starts it afresh.
CODE_CACHE = 400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_key(name: str = "doc_id") -> Column:
    """A row's id as a long; a missing id counts as the largest."""
    return F.coalesce(F.col(name).cast("long"), F.lit(NO_ID))


def text_key(name: str = "text") -> Column:
    """Tells rows apart that share an id but not their text."""
    return F.xxhash64(F.coalesce(F.col(name), F.lit("")))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, with as many underscores before them as it takes to clash with no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``.

    Where that is unset, a folder under the warehouse serves a local session; on a cluster nothing says that
    the executors see it, so it is refused.
    """
    set_already = spark.sparkContext._jsc.sc().getCheckpointDir()
    named = spark.conf.get("spark.checkpoint.dir", None) or (set_already.get() if set_already.isDefined() else None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written once to the checkpoint folder that all executors share."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_root(spark))
    return df.checkpoint()


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh path in the folder that the driver and all executors see."""
    return f"{shared_root(spark)}/{purpose}-{uuid.uuid4().hex}"


def remove_at_exit(spark: SparkSession, path: str) -> str:
    """Makes a folder and has it removed when the session's JVM ends."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(place)
    fs.deleteOnExit(place)
    return path


def written(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, for rows that pack far better by column.

    The table goes when the session's JVM ends.
    """
    spark = df.sparkSession
    path = remove_at_exit(spark, shared_folder(spark, purpose)) + "/table"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def utf8(column: pa.Array) -> list[bytes | None]:
    """The texts of an Arrow string column as UTF-8, without decoding them."""
    binary = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(binary).to_pylist()


class WordCodes(dict):
    """64-bit codes of words: the same for a word in every worker."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CODE_CACHE:
            self.clear()
        code = self[word] = xxhash.xxh3_64_intdigest(word)
        return code

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit codes that spreads every input bit (the splitmix finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_codes(codes: np.ndarray, k: int) -> np.ndarray:
    """A code for each run of ``k`` words; none if there are fewer words."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    factor = np.uint64(0x9E3779B97F4A7C15)
    for i in range(k):
        total = total * factor + codes[i : i + n]
    return mix(total)


class Sent:
    """A value broadcast to the workers with its code: they need no copy of the package."""

    def __init__(self, spark: SparkSession, value):
        self.bytes = spark.sparkContext.broadcast(cloudpickle.dumps(value))
        self.here: list = []

    def __getstate__(self):
        return {"bytes": self.bytes, "here": []}

    def release(self) -> None:
        """Frees the workers' copies, once no plan that is still to run needs them."""
        self.bytes.unpersist()

    @property
    def value(self):
        if not self.here:
            self.here.append(pickle.loads(self.bytes.value))
        return self.here[0]


def slices(n: int, size: int) -> Iterator[slice]:
    for at in range(0, n, size):
        yield slice(at, min(n, at + size))


def give_back() -> None:
    """Returns memory that Python and Arrow have freed to the machine: a worker lives on, beside its executor's heap."""
    for pool in (pa.default_memory_pool(), pa.system_memory_pool()):  # the latter is the C library's, which numpy and Python use
        pool.release_unused()


def arrow_map(df: DataFrame, function: Callable, schema: StructType | str) -> DataFrame:
    """``mapInArrow`` for a function from one record batch to record batches."""

    def run(batches):
        give_back()  # what the worker's earlier tasks held
        for batch in batches:
            if batch.num_rows:
                yield from function(batch)

    return df.mapInArrow(run, schema)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
