"""Discovery of files: a scan of metadata with filters and orders.

``find_files`` lists folders on the driver through Hadoop's file system API, so that it reaches any store that Spark
reads, and sees empty and hidden files as well, which the binaryFile source leaves out.  ``scan``
is the distributed form, for folders too large to list: the same rows from the binaryFile source, whose
content column is never read.  ``unscanned`` names the files by which the two differ.  Folders and files may have any
name: only a filter's pattern is a pattern.
"""

from __future__ import annotations

import fnmatch
import os.path
import re
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import datetime
from enum import Enum

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F

from colloquy.functions.text import extension
from colloquy.schema import DirectoryNotFoundError, InvalidFilterError

TRANSCRIPT_EXTENSIONS = (".txt", ".srt", ".vtt", ".json")
FILES = "path string, length long, modificationTime timestamp"


class SortOrder(Enum):
    NAME = "name"
    NAME_DESC = "name_desc"
    SIZE = "size"
    SIZE_DESC = "size_desc"
    DATE = "date"
    DATE_DESC = "date_desc"


@dataclass(frozen=True)
class FileFilter:
    """All limits include their ends."""

    pattern: str = "*.txt"
    recursive: bool = False
    min_size: int | None = None
    max_size: int | None = None
    after_date: datetime | None = None
    before_date: datetime | None = None
    extensions: tuple[str, ...] = ()

    def __post_init__(self):
        for name in ("min_size", "max_size"):
            if (getattr(self, name) or 0) < 0:
                raise InvalidFilterError(f"{name} must not be negative")
        if self.min_size is not None and self.max_size is not None and self.min_size > self.max_size:
            raise InvalidFilterError("min_size exceeds max_size")
        if self.after_date is not None and self.before_date is not None and self.after_date > self.before_date:
            raise InvalidFilterError("after_date is later than before_date")

    def condition(self) -> Column:
        """Sizes and dates are plain comparisons, which the source takes over."""
        keep = F.lit(True)
        for column, low, high in (("length", self.min_size, self.max_size), ("modificationTime", self.after_date, self.before_date)):
            if low is not None:
                keep = keep & (F.col(column) >= F.lit(low))
            if high is not None:
                keep = keep & (F.col(column) <= F.lit(high))
        if self.extensions:
            keep = keep & extension(F.col("path")).isin([e.lower() for e in self.extensions])
        return keep


def ordered(files: DataFrame, order: SortOrder | None) -> DataFrame:
    """By lower-case name, size or date; equal ones by path."""
    if order is None:
        return files
    key = {"NAME": F.lower(F.element_at(F.split("path", "/"), -1)), "SIZE": F.col("length"), "DATE": F.col("modificationTime")}[order.name.removesuffix("_DESC")]
    return files.orderBy(key.desc() if order.name.endswith("_DESC") else key.asc(), "path")


def hadoop_glob(pattern: str) -> str:
    """A pattern as ``fnmatch`` knows it, in Hadoop's syntax, which has alternatives in braces and escapes as well."""
    out, i = "", 0
    while i < len(pattern):
        c, i = pattern[i], i + 1
        if c == "[":
            inverse = pattern[i : i + 1] == "!"
            end = pattern.find("]", i + inverse + 1)
            if end >= 0:
                own = "".join(x if x.isalnum() or x == "-" else f"\\{x}" for x in pattern[i + inverse : end])
                out, i = f"{out}[{'^' if inverse else ''}{own}]", end + 1
                continue
        out += c if c in "*?" or c not in "[]{}\\" else f"\\{c}"
    return out


def file_lengths(spark: SparkSession, paths: list[str]) -> list[int | None]:
    """The files' lengths; null for one that is missing."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def length(path: str) -> int | None:
        place = jvm.org.apache.hadoop.fs.Path(path)
        fs = place.getFileSystem(conf)
        return fs.getFileStatus(place).getLen() if fs.exists(place) else None

    with ThreadPoolExecutor(16) as pool:
        return list(pool.map(length, paths))


def as_pattern(path: str) -> str:
    """A pattern that only this path matches: Spark takes a list of paths for patterns."""
    return re.sub(r"([*?{}\[\]\\])", r"\\\1", path)


def files_reader(spark: SparkSession, directory: str, where: FileFilter) -> DataFrameReader:
    """The binaryFile source for the files under one folder, which must exist and is no pattern."""
    _root(spark, directory)
    reader = spark.read.format("binaryFile").option("__globPaths__", "false").option("ignoreMissingFiles", "true")
    return reader.option("pathGlobFilter", hadoop_glob(where.pattern)).option("recursiveFileLookup", str(where.recursive).lower())


def scan(spark: SparkSession, directory: str, where: FileFilter = FileFilter(), order: SortOrder | None = None) -> DataFrame:
    """path, length and modificationTime of the files under a folder, by Spark's own listing."""
    return ordered(files_reader(spark, directory, where).load(directory).select("path", "length", "modificationTime").where(where.condition()), order)


def _root(spark: SparkSession, directory: str):
    """A folder's file system and path."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(directory)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root) or not fs.getFileStatus(root).isDirectory():
        raise DirectoryNotFoundError(directory)
    return fs, root


def _listed(spark: SparkSession, directory: str, where: FileFilter, follow_symlinks: bool, only_unscanned: bool) -> DataFrame:
    fs, root = _root(spark, directory)
    local = fs.getUri().getScheme() == "file"  # the API tells links of other stores only
    rows, folders = [], [(root, False, False)]
    while folders:
        folder, hidden_above, link_above = folders.pop()
        for status in fs.listStatus(folder):
            path = status.getPath()
            name = path.getName()
            if not status.isDirectory() and not fnmatch.fnmatchcase(name, where.pattern):
                continue
            hidden = hidden_above or name.startswith((".", "_"))
            link = link_above or _is_link(path, status, local)
            if status.isDirectory():
                if where.recursive and (follow_symlinks or only_unscanned or not link):
                    folders.append((path, hidden, link))
                continue
            length = status.getLen()
            if (length == 0 or hidden or link) if only_unscanned else (follow_symlinks or not link):
                rows.append((path.toString(), length, status.getModificationTime(), link))
    found = spark.createDataFrame(rows, "path string, length long, millis long, link boolean")
    return found.select("path", "length", F.timestamp_millis("millis").alias("modificationTime"), "link").where(where.condition())


def _is_link(path, status, local: bool) -> bool:
    return os.path.islink(path.toUri().getPath()) if local else status.isSymlink()


def find_files(spark: SparkSession, directory: str, where: FileFilter = FileFilter(), order: SortOrder | None = None, follow_symlinks: bool = False) -> DataFrame:
    """The same rows from a listing on the driver, with empty and hidden files; files that vanish meanwhile are left out."""
    return ordered(_listed(spark, directory, where, follow_symlinks, False).drop("link"), order)


def unscanned(spark: SparkSession, directory: str, where: FileFilter = FileFilter()) -> DataFrame:
    """The files by which ``scan`` differs: empty and hidden ones, which it doesn't have, and links (``link``), which it follows."""
    return _listed(spark, directory, where, False, True)


def find_by_pattern(spark: SparkSession, directory: str, pattern: str, recursive: bool = False, order: SortOrder | None = None) -> DataFrame:
    return find_files(spark, directory, FileFilter(pattern=pattern, recursive=recursive), order)


def find_transcript_files(spark: SparkSession, directory: str, recursive: bool = True, order: SortOrder | None = SortOrder.NAME) -> DataFrame:
    return find_files(spark, directory, FileFilter(pattern="*", recursive=recursive, extensions=TRANSCRIPT_EXTENSIONS), order)


def discover_files(spark: SparkSession, directory: str, pattern: str = "*.txt", recursive: bool = False) -> DataFrame:
    return find_by_pattern(spark, directory, pattern, recursive)


def total_size(files: DataFrame) -> DataFrame:
    return files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("total_size"))


def count_by_extension(files: DataFrame) -> DataFrame:
    own = F.coalesce(F.nullif(extension(F.col("path")), F.lit("")), F.lit("(no extension)"))
    return files.groupBy(own.alias("extension")).agg(F.count("*").alias("n"))
