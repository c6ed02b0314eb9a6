"""Selections of their own for each request: tables of specifications, where pages.py takes one literal for all documents.

requests: job_id, doc_id, spec (a text); a document may be in any number of them. pages: doc_id, page_no (1 to n without
gaps) and whatever else a page carries. A specification is read and clipped where its row lies, against the number of the
document's pages, so that places are known before pages are looked up: what is joined is (doc_id, page_no), which splits a
document of many pages, and nothing is sorted or numbered by job. Malformed specifications are failed rows of outcomes().
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagefold.functions import intervals, pagespec
from pagefold.operators.pages import page_counts

#: What a specification of each kind of request is.
KINDS = ("extract", "remove", "remove_each", "split", "unassigned")


def _counted(pages: DataFrame, requests: DataFrame) -> DataFrame:
    """With n, the pages of each request's document; 0 for one without."""
    counts = page_counts(pages).select("doc_id", F.col("page_count").cast("int").alias("n"))
    return requests.select("job_id", "doc_id", "spec").join(counts, "doc_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def _looked_up(pages: DataFrame, places: DataFrame) -> DataFrame:
    """places: job_id, doc_id, page_no, out_page and more; with the rest of each page. page_no becomes src_page."""
    kind = pages.schema["page_no"].dataType
    joined = pages.join(places.withColumn("page_no", F.col("page_no").cast(kind)), ["doc_id", "page_no"])
    first = [c for c in places.columns if c not in ("doc_id", "page_no")]
    return joined.select(*first, "doc_id", F.col("page_no").alias("src_page"), *(c for c in pages.columns if c not in ("doc_id", "page_no")))


def _there(n: Column, pages: Column) -> Column:
    return F.filter(pages, lambda p: (p >= 1) & (p <= n))


def _removed(kind: str, n: Column, spec: Column) -> Column:
    """The set that a removal takes from 1..n, or null."""
    listed = _there(n, pagespec.ints(spec))
    return intervals.merged(intervals.of_pages(listed)) if kind == "remove" else intervals.within(intervals.parked(F.array_sort(listed)), n)


def _unfolded(kept: DataFrame) -> DataFrame:
    """kept: job_id, doc_id, left (intervals). page_no and out_page of each page."""
    each = kept.select("job_id", "doc_id", F.explode(intervals.numbered(F.col("left"))).alias("i"))
    one = each.select("job_id", "doc_id", "i.*", F.explode(F.sequence("i.lo", "i.hi")).alias("page_no"))
    return one.select("job_id", "doc_id", "page_no", (F.col("before") + F.col("page_no") - F.col("lo") + 1).cast("int").alias("out_page"))


def extracted(pages: DataFrame, requests: DataFrame) -> DataFrame:
    """spec: integers ('3, 1,3'), whose order and duplicates are kept; pages that the document lacks are skipped.
    job_id, out_page, doc_id, src_page and the rest of the page."""
    listed = _there(F.col("n"), pagespec.ints(F.col("spec")))
    places = _counted(pages, requests).select("job_id", "doc_id", F.posexplode(listed).alias("k", "page_no"))
    return _looked_up(pages, places.select("job_id", "doc_id", "page_no", (F.col("k") + 1).alias("out_page")))


def left(pages: DataFrame, requests: DataFrame, one_by_one: bool = False) -> DataFrame:
    """What is left without the pages of spec, integers. one_by_one: deleted highest first, each by its place among those
    then left, so that a page named twice takes the next one along. The columns of extracted()."""
    kind = "remove_each" if one_by_one else "remove"
    kept = _counted(pages, requests).select("job_id", "doc_id", intervals.gaps(_removed(kind, F.col("n"), F.col("spec")), F.col("n")).alias("left"))
    return _looked_up(pages, _unfolded(kept))


def parts(pages: DataFrame, requests: DataFrame) -> DataFrame:
    """spec: groups ('1-2;4'); null or blank: a part for each page. Empty groups give no rows, but keep their number. The
    columns of extracted(), with part_no."""
    groups = _counted(pages, requests).select("job_id", "doc_id", F.posexplode(pagespec.groups(F.col("spec"), F.col("n"))).alias("g", "group"))
    places = groups.select("job_id", "doc_id", (F.col("g") + 1).alias("part_no"), F.posexplode("group").alias("k", "page_no"))
    return _looked_up(pages, places.select("job_id", "doc_id", "part_no", "page_no", (F.col("k") + 1).alias("out_page")))


def unassigned(pages: DataFrame, requests: DataFrame) -> DataFrame:
    """spec: groups, as a form has them; a form without groups assigns nothing. job_id, doc_id, page_no of the pages in none:
    the gaps between the groups' pages."""
    kept = _counted(pages, requests).select("job_id", "doc_id", intervals.gaps(_assigned(F.col("n"), F.col("spec")), F.col("n")).alias("left"))
    return _unfolded(kept).drop("out_page")


def _assigned(n: Column, spec: Column) -> Column:
    blank = F.coalesce(F.regexp_replace(spec, r"[\x00-\x20]", "") == "", F.lit(True))
    return F.when(blank, intervals.empty()).otherwise(intervals.merged(intervals.of_pages(F.flatten(pagespec.groups(spec, n)))))


def outcomes(pages: DataFrame, requests: DataFrame, kind: str) -> DataFrame:
    """One row for each request: job_id, doc_id, success, n_pages (of all parts together; null if it fails) and cause. kind:
    one of KINDS. A specification that is null is malformed but for a split, where it stands for single pages."""
    n, spec = F.col("n"), F.col("spec")
    size = {
        "extract": F.size(_there(n, pagespec.ints(spec))).cast("long"),
        "remove": n - intervals.count(_removed("remove", n, spec)),
        "remove_each": n - intervals.count(_removed("remove_each", n, spec)),
        "split": F.aggregate(pagespec.groups(spec, n), F.lit(0).cast("long"), lambda a, g: a + F.size(g)),
        "unassigned": n - intervals.count(_assigned(n, spec)),
    }[kind]
    read = pagespec.groups(spec, n) if kind in ("split", "unassigned") else pagespec.ints(spec)
    ok = read.isNotNull()
    cause = (pagespec.groups_cause if kind in ("split", "unassigned") else pagespec.list_cause)(F.coalesce(spec, F.lit("")))
    return _counted(pages, requests).select("job_id", "doc_id", ok.alias("success"), F.when(ok, size.cast("long")).alias("n_pages"), F.when(~ok, cause).alias("cause"))
