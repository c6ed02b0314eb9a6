"""Files as they arrive: the same page rows as in a batch. It has no event time and keeps no state but which files were read."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagefold.operators.results import MOST_BYTES
from pagefold.sources import documents

FILES = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, folder: str, pattern: str = "*.pdf", most_bytes: int = MOST_BYTES) -> DataFrame:
    """doc_id (of the path), name, content of each new file within the size limit."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", pattern).load(folder).filter(F.col("length") <= most_bytes)
    return files.select(F.xxhash64("path").alias("doc_id"), F.element_at(F.split("path", "/"), -1).alias("name"), "content")


def pages_to(spark: SparkSession, folder: str, target: str, checkpoint: str):
    """Appends the page rows of all files that are there, and starts again from the checkpoint the next time."""
    rows = documents.pages(arriving(spark, folder))
    return rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
