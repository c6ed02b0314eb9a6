"""Files of documents: listing, size limit, lookup by name."""

import os
import posixpath
import re
import tempfile
import uuid
from collections.abc import Callable
from urllib.parse import urlparse

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagefold.functions import names
from pagefold.operators.results import FAILED, MOST_BYTES, outcome
from pagefold.sources.batches import gathered, pieces

NOT_FOUND = "File not found: "
# Fixed value.
ACCESS_DENIED = "Access denied: file is outside the allowed directory"


def new_folder(spark: SparkSession) -> str:
    """A folder of its own in spark.checkpoint.dir, which driver and executors share; of this machine's only where that is
    unset and all tasks run here, as in tests."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{(folder or 'file://' + tempfile.mkdtemp(prefix='spark-')).rstrip('/')}/files-{uuid.uuid4().hex}"


def listed(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """name, path, length of the files; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "path", "length")


def loaded(spark: SparkSession, folder: str, pattern: str = "*.pdf", most_bytes: int = MOST_BYTES) -> DataFrame:
    """name, path, length, content of the files within the size limit. The filter on length is pushed to the source, which
    then does not open larger files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder).filter(F.col("length") <= most_bytes)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "path", "length", "content")


def too_large(spark: SparkSession, folder: str, pattern: str = "*.pdf", most_bytes: int = MOST_BYTES) -> DataFrame:
    return listed(spark, folder, pattern).filter(F.col("length") > most_bytes)


def accepted(files: DataFrame, suffix: str = ".pdf", most_files: int = 20, most_bytes: int = MOST_BYTES) -> DataFrame:
    """files: job_id, pos, name, length, as a client offers them. Those of each job that a form would take: the first
    most_files of the suffix, in any case, that are not too large."""
    fine = files.filter(F.lower("name").endswith(suffix) & (F.col("length") <= most_bytes))
    return fine.withColumn("place", F.row_number().over(Window.partitionBy("job_id").orderBy("pos"))).filter(F.col("place") <= most_files).drop("place")


def limited(files: DataFrame, most_file: int = MOST_BYTES, most_request: int = MOST_BYTES) -> DataFrame:
    """files: job_id, length. With refused: whether the whole job is, as one of its files or all of them together are over
    the limit. A null length counts as 0. Jobs are summed before they are joined, so that a job of many files is no single
    task's."""
    sums = files.groupBy("job_id").agg(F.coalesce(F.max("length"), F.lit(0)).alias("most"), F.coalesce(F.sum("length"), F.lit(0)).alias("all"))
    over = sums.select(F.col("job_id").alias("__job"), ((F.col("most") > most_file) | (F.col("all") > most_request)).alias("refused"))
    return files.join(over, F.col("job_id").eqNullSafe(F.col("__job"))).drop("__job")


def refused(files: DataFrame, most_file: int = MOST_BYTES, most_request: int = MOST_BYTES) -> DataFrame:
    """files: job_id, length. A row for each job: job_id, n_files, n_bytes, status (413 if it is refused), success, message."""
    sums = files.groupBy("job_id").agg(F.count("*").alias("n_files"), F.coalesce(F.sum("length"), F.lit(0)).alias("n_bytes"), F.coalesce(F.max("length"), F.lit(0)).alias("most"))
    o = outcome(F.when((F.col("most") > most_file) | (F.col("n_bytes") > most_request), F.lit("too_large")).otherwise(F.lit("done")), F.lit("OK"))
    return sums.select("job_id", "n_files", "n_bytes", o["status"].alias("status"), o["success"].alias("success"), o["message"].alias("message"))


def _within(folder: str) -> Callable[[str | None], bool | None]:
    """Whether a path, after all links and dots are followed, lies in folder. Where the store has no links (another scheme
    than file) only dots are followed."""
    local = not urlparse(folder).scheme or urlparse(folder).scheme == "file"
    plain = lambda uri: re.sub("^[a-z0-9+.-]+:(//[^/]*)?", "", uri)
    follow = os.path.realpath if local else posixpath.normpath
    return lambda p: None if p is None else follow(plain(p)).startswith(follow(plain(folder)).rstrip("/") + "/")


def resolved(asked: DataFrame, folder: str) -> DataFrame:
    """asked: path and more. With inside: whether the path, after all links and dots are followed, still lies in folder.
    Links are followed on executors, and where the store has none (another scheme than file) only dots are."""
    within = _within(folder)

    @F.pandas_udf("boolean")
    def inside(path: pd.Series) -> pd.Series:
        return path.map(within)

    return asked.withColumn("inside", inside("path"))


def _content(path: str) -> bytes:
    from pyarrow import fs

    local = re.sub("^file:(//)?", "", path)
    store, at = (fs.LocalFileSystem(), local) if local.startswith("/") else fs.FileSystem.from_uri(path)
    with store.open_input_stream(at) as f:
        return f.read()


def download(spark: SparkSession, asked: DataFrame, folder: str) -> DataFrame:
    """asked: name, any number of them. Each with verdict (OK, the rule that it breaks, that there is no such file, or that it
    lies outside the folder) and content. Names are joined with the listing, and executors read the files that were asked
    for and no others; a task holds a few megabytes of them at a time, or one file. Of equal names, the file written last
    counts."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    stored = files.select(F.element_at(F.split("path", "/"), -1).alias("__name"), "path", "modificationTime")
    last = stored.groupBy("__name").agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path"))
    checked = asked.select("name", names.verdict(F.col("name")).alias("verdict"))
    known = checked.join(last, (F.col("name") == F.col("__name")) & (F.col("verdict") == "OK"), "left")
    missing = (F.col("verdict") == "OK") & F.col("path").isNull()
    judged = known.select("name", F.when(missing, F.concat(F.lit(NOT_FOUND), F.col("name"))).otherwise(F.col("verdict")).alias("verdict"), "path")
    within, kind = _within(folder), pa.schema([("name", pa.string()), ("verdict", pa.string()), ("content", pa.binary())])

    def read(batches):
        def rows():
            for b in pieces(batches):
                for name, verdict, path in zip(*(b.column(c).to_pylist() for c in ("name", "verdict", "path")), strict=True):
                    inside = within(path)
                    content = _content(path) if inside else None
                    yield {"name": name, "verdict": ACCESS_DENIED if inside is False else verdict, "content": content}, len(content or b"")

        return gathered(rows(), kind)

    return judged.mapInArrow(read, "name string, verdict string, content binary")


def lookup(asked: DataFrame, stored: DataFrame) -> DataFrame:
    """asked: name. stored: name, content. Each asked name with verdict (OK, the rule that it breaks, or that there is no
    such file) and content."""
    checked = asked.select("name", names.verdict(F.col("name")).alias("verdict"))
    found = checked.join(stored.select(F.col("name").alias("__name"), "content"), (F.col("name") == F.col("__name")) & (F.col("verdict") == "OK"), "left")
    missing = (F.col("verdict") == "OK") & F.col("__name").isNull()
    return found.select("name", F.when(missing, F.concat(F.lit(NOT_FOUND), F.col("name"))).otherwise(F.col("verdict")).alias("verdict"), "content")


def failed_download(cause):
    return F.concat(F.lit(f"{FAILED['download']}: "), cause)
