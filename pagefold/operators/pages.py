"""Page algebra: documents are tables of pages, and order is a column.

pages: doc_id, page_no (from 1) and whatever else a page carries. A selection is a small table of places and page numbers
that the caller states, so it is broadcast as a literal: its size does not follow the data.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagefold.functions import pagespec

INVALID_PAGE = "Invalid page number"
#: Pages of a stated selection at most; longer ones are to be given as a table.
STATED = 100_000


def selection(spark: SparkSession, rows: Sequence[tuple[int, ...]], names: str) -> DataFrame:
    if len(rows) > STATED:
        raise ValueError(f"a stated selection has {STATED} rows at most")
    return F.broadcast(spark.createDataFrame(list(rows), names))


def page_counts(pages: DataFrame) -> DataFrame:
    """doc_id, page_count, message."""
    return pages.groupBy("doc_id").agg(F.count("*").alias("page_count")).withColumn("message", F.concat(F.lit("Pages: "), F.col("page_count").cast("string")))


def renumbered(pages: DataFrame, by: Sequence[str], order: Sequence[str | Column], name: str = "out_page") -> DataFrame:
    return pages.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def merge(pages: DataFrame, files: DataFrame) -> DataFrame:
    """files: job_id, pos, doc_id; a document may stand in a job more than once. The pages of each job's documents in order
    of pos and page_no: job_id, out_page, src_doc, src_page and the rest of the page. Only a job's files are put in order;
    pages follow from what stands before their file, so a job of many pages is no single task's."""
    order = Window.partitionBy("job_id").orderBy("pos", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.join(page_counts(pages).select("doc_id", "page_count"), "doc_id").withColumn("before", F.coalesce(F.sum("page_count").over(order), F.lit(0)))
    joined = placed.drop("page_count").join(renumbered(pages, ["doc_id"], ["page_no"], "within"), "doc_id").withColumnsRenamed({"doc_id": "src_doc", "page_no": "src_page"})
    return joined.withColumn("out_page", (F.col("before") + F.col("within")).cast("int")).drop("pos", "before", "within")


def dropped(files: DataFrame, place: int) -> DataFrame:
    """files without the one at a place (from 0) of each job, pos counted anew from 0; a place out of bounds drops none."""
    w = Window.partitionBy("job_id").orderBy("pos")
    return files.withColumn("pos", F.row_number().over(w) - 1).filter(F.col("pos") != place).withColumn("pos", F.when(F.col("pos") > place, F.col("pos") - 1).otherwise(F.col("pos")).cast("int"))


def reordered(files: DataFrame, start: int, to: int) -> DataFrame:
    """files with the one at place start (from 0) moved to another, in each job; a move out of bounds changes nothing."""
    n = F.count("*").over(Window.partitionBy("job_id"))
    place = F.row_number().over(Window.partitionBy("job_id").orderBy("pos")) - 1
    shifted = (
        F.when(F.col("place") == start, F.lit(to))
        .when((F.lit(start) < F.lit(to)) & F.col("place").between(start + 1, to), F.col("place") - 1)
        .when((F.lit(start) > F.lit(to)) & F.col("place").between(to, start - 1), F.col("place") + 1)
        .otherwise(F.col("place"))
    )
    inside = (F.lit(start) >= 0) & (F.lit(to) >= 0) & (F.col("n") > start) & (F.col("n") > to)
    return files.withColumn("place", place).withColumn("n", n).withColumn("pos", F.when(inside, shifted).otherwise(F.col("place")).cast("int")).drop("place", "n")


def split_pages(pages: DataFrame) -> DataFrame:
    """A part of its own for each page."""
    return pages.select(pages["*"], F.col("page_no").alias("part_no"), F.lit(1).alias("out_page"))


def split_groups(pages: DataFrame, parts: DataFrame) -> DataFrame:
    """parts: part_no, pos, page_no (see stated_groups). Pages of each part in order of pos; a page may be in several
    parts, pages in none go, and a part without pages gives none."""
    joined = pages.join(parts, "page_no").withColumnRenamed("page_no", "src_page")
    return renumbered(joined, ["doc_id", "part_no"], ["pos"]).drop("pos")


def stated_groups(spark: SparkSession, text: str, most: int) -> DataFrame:
    """'1-2;4' as part_no, pos, page_no up to page most; empty groups keep their number. Fails on a malformed text."""
    parsed = spark.range(1).select(pagespec.groups(F.lit(text), F.lit(most)).alias("g")).first()["g"]
    if parsed is None:
        raise ValueError(f"malformed page groups: {text}")
    rows = [(k, p, page) for k, g in enumerate(parsed, 1) for p, page in enumerate(g, 1)]
    return selection(spark, rows, "part_no int, pos int, page_no int")


def split_summary(outputs: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """outputs: doc_id, part_no, name, a row for each part that was written. doc_id, message, outputs. With docs (doc_id), a
    document without parts has a row too."""
    parts = F.array_sort(F.collect_list(F.struct("part_no", "name")))
    found = outputs.groupBy("doc_id").agg(F.count("*").alias("k"), F.array_join(F.transform(parts, lambda x: x["name"]), ",").alias("outputs"))
    if docs is not None:
        found = docs.select("doc_id").distinct().join(found, "doc_id", "left").select("doc_id", F.coalesce("k", F.lit(0)).alias("k"), F.coalesce("outputs", F.lit("")).alias("outputs"))
    return found.select("doc_id", F.concat(F.lit("PDF split into "), F.col("k").cast("string"), F.lit(" documents")).alias("message"), "outputs")


def page_outcomes(pages: DataFrame, outputs: DataFrame) -> DataFrame:
    """doc_id and n_pages of what extract(), remove() or remove_each() gives for each document of pages: 0 where no page is
    left, which is a document without pages, not a failure."""
    left = outputs.groupBy("doc_id").agg(F.count("*").alias("n_pages"))
    return pages.select("doc_id").distinct().join(left, "doc_id", "left").select("doc_id", F.coalesce("n_pages", F.lit(0)).alias("n_pages"))


def extract(pages: DataFrame, chosen: DataFrame) -> DataFrame:
    """chosen: pos, page_no, in the order of the request and with its duplicates; pages that a document lacks are skipped."""
    joined = pages.join(chosen, "page_no").withColumnRenamed("page_no", "src_page")
    return renumbered(joined, ["doc_id"], ["pos"]).drop("pos")


def remove(pages: DataFrame, chosen: DataFrame) -> DataFrame:
    """chosen: page_no. The other pages, renumbered."""
    rest = pages.join(chosen, "page_no", "left_anti")
    return renumbered(rest, ["doc_id"], ["page_no"]).withColumnRenamed("page_no", "src_page")


def remove_each(pages: DataFrame, chosen: Sequence[int]) -> DataFrame:
    """As remove, deleting one by one, highest first: k copies of a page take the first k pages from it on that are left."""
    kept = page_counts(pages).select("doc_id", F.posexplode(pagespec.left_after(F.array(*map(F.lit, chosen)).cast("array<int>"), F.col("page_count").cast("int"))).alias("k", "page_no"))
    out = pages.join(kept.select("doc_id", F.col("page_no").cast(pages.schema["page_no"].dataType).alias("page_no"), (F.col("k") + 1).alias("out_page")), ["doc_id", "page_no"])
    return out.withColumnRenamed("page_no", "src_page")


def unassigned(pages: DataFrame, parts: DataFrame) -> DataFrame:
    """Pages in no part."""
    return pages.join(parts, "page_no", "left_anti").select("doc_id", "page_no")


def toggled(clicks: DataFrame) -> DataFrame:
    """clicks: doc_id, page_no. Pages clicked an odd number of times."""
    return clicks.groupBy("doc_id", "page_no").agg(F.count("*").alias("n")).filter("n % 2 = 1").drop("n")


def exclusive(clicks: DataFrame) -> DataFrame:
    """clicks: doc_id, seq, group_id, page_no. The group of each page: a click takes a page out of all groups and, unless it
    was in the clicked one, puts it there; so a page is in the group of its last run of clicks if that run is odd."""
    w = Window.partitionBy("doc_id", "page_no")
    back = w.orderBy(F.desc("seq"))
    run = clicks.withColumn("last", F.first("group_id").over(back)).withColumn("other", F.sum((F.col("group_id") != F.col("last")).cast("int")).over(back.rowsBetween(Window.unboundedPreceding, 0)))
    return run.filter("other = 0").groupBy("doc_id", "page_no").agg(F.first("last").alias("group_id"), F.count("*").alias("n")).filter("n % 2 = 1").drop("n")


def guarded(pages: DataFrame, page_no: int, done: str, failed: str) -> DataFrame:
    """For each document whether it has a stated page: doc_id, page_no, success, message."""
    ok = F.lit(page_no).between(F.lit(1), F.col("page_count"))
    message = F.when(ok, F.lit(done)).otherwise(F.lit(f"{failed}: {INVALID_PAGE}"))
    return page_counts(pages).select("doc_id", F.lit(page_no).alias("page_no"), message.alias("message"), ok.alias("success"))
