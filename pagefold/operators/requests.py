"""Requests of all kinds as one table, and one row of results for each.

requests: job_id, operation (a route), doc_ids (its files in order), name (the original file name), params (a map of texts, as a
form sends them) and, for signatures, image (bytes). documents: doc_id, page_count, length (bytes) and error (why it can't
be read, null if it can). stored: name of files that may be downloaded.

All routes share one pass: requests are joined once with what is known of their files, summed by job (and once with stored
names), and then each row is judged by expressions of its own route, in the order in which the steps of a request come:
size, parameters, numbers, files, the operation itself.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagefold.functions import drawing, names, pagespec
from pagefold.operators import overlays, results
from pagefold.operators.pages import INVALID_PAGE
from pagefold.sources import images
from pagefold.sources.files import NOT_FOUND

#: Of each route: whose messages it has, the suffix and extension of its output, its required parameters in order.
ROUTES = {
    "merge": ("merge", "merged", "pdf", ()),
    "split": ("split", "split", "pdf", ()),
    "extract": ("extract", "extracted", "pdf", ("pages",)),
    "remove": ("remove", "removed", "pdf", ("pages",)),
    "watermark": ("stamp", "watermarked", "pdf", ("text",)),
    "add-text": ("text", "text_added", "pdf", ("text",)),
    "add-signature": ("signature", "signed", "pdf", ()),
    "redact": ("cover", "redacted", "pdf", ("x", "y", "width", "height")),
    "redact-multiple": ("cover", "redacted", "pdf", ("redactions",)),
    "convert/markdown": ("markdown", "markdown", "md", ()),
    "convert/docx": ("docx", "docx", "docx", ()),
    "info": ("info", None, None, ()),
    "download": ("download", None, None, ("filename",)),
}
#: Numbers that a route reads; a blank one counts as not given.
FLOATS = {"watermark": ("x", "y", "rotation", "opacity"), "add-text": ("x", "y", "fontSize"), "add-signature": ("x", "y"), "redact": ("x", "y", "width", "height")}
PAGED = ("add-text", "add-signature", "redact")
NUMERIC = ("x", "y", "width", "height")
COLUMNS = {"operation": "string", "doc_ids": "array<bigint>", "name": "string", "params": "map<string,string>", "image": "binary"}
NO_DOCUMENT, NO_IMAGE = "no such document", "not a PNG or JPEG image"


def _param(name: str) -> Column:
    return F.try_element_at(F.col("params"), F.lit(name))


def _given(name: str) -> Column:
    """A numeric parameter, trimmed; null where blank."""
    trimmed = F.regexp_replace(_param(name), r"^[\x00-\x20]+|[\x00-\x20]+$", "")
    return F.nullif(trimmed, F.lit(""))


def _number(name: str, default: float | None = None) -> Column:
    return F.coalesce(_given(name).try_cast("double"), F.lit(default).cast("double"))


def _page() -> Column:
    return F.coalesce(pagespec.integer(_given("page")), F.lit(1))


def _case(by_route: dict[str, Column], other: Column) -> Column:
    out = F.when(F.lit(False), other)
    for route, value in by_route.items():
        out = out.when(F.col("operation") == route, value)
    return out.otherwise(other)


def facts(requests: DataFrame, documents: DataFrame) -> DataFrame:
    """requests with n_files, n_bytes and most_bytes of all files, n_pages of the first, and unread: why the first that
    can't be read can't."""
    each = requests.select("job_id", F.posexplode("doc_ids").alias("place", "doc_id")).join(documents.select("doc_id", "page_count", "length", "error", F.lit(True).alias("there")), "doc_id", "left")
    error = F.when(F.col("there").isNull(), F.lit(NO_DOCUMENT)).otherwise(F.col("error"))
    sums = each.withColumn("why", error).groupBy("job_id").agg(
        F.count("*").alias("n_files"), F.sum("length").alias("n_bytes"), F.max("length").alias("most_bytes"), F.min_by("page_count", "place").alias("n_pages"),
        F.min_by("why", F.when(F.col("why").isNotNull(), F.col("place"))).alias("unread"), F.min_by("doc_id", "place").alias("doc_id"),
    )
    known = requests.join(sums, "job_id", "left")
    return known.withColumns({"n_files": F.coalesce("n_files", F.lit(0)), "n_pages": F.coalesce("n_pages", F.lit(0)).cast("int")})


def answered(requests: DataFrame, documents: DataFrame, stored: DataFrame, most_bytes: int = results.MOST_BYTES) -> DataFrame:
    """One row for each request: job_id, doc_id (its first file), operation, status, success, message, outputs (names).

    job_id tells requests apart. A route that does not exist, a request without the file that it needs, and a number
    that can't be read are unexpected errors. Digits of outputs follow from job_id, so that a request that is answered
    again has the same names. Null params are none; a null operation is no route. Columns that are not there count as null, others
    are not looked at.
    """
    own = requests.select("job_id", *((F.col(c) if c in requests.columns else F.lit(None)).cast(kind).alias(c) for c, kind in COLUMNS.items()))
    r = facts(own.withColumns({"params": F.coalesce("params", F.create_map().cast("map<string,string>")), "operation": F.coalesce("operation", F.lit(""))}), documents)
    held = stored.select(F.col("name").alias("filename")).distinct().withColumn("found", F.lit(True))
    r = r.withColumn("filename", F.when(F.col("operation") == "download", _param("filename"))).join(held, "filename", "left")

    files = F.col("operation") != "download"
    too_large = files & ((F.coalesce("most_bytes", F.lit(0)) > most_bytes) | (F.coalesce("n_bytes", F.lit(0)) > most_bytes))
    no_file = files & ((F.col("n_files") == 0) | (F.col("operation") == "add-signature") & F.col("image").isNull())
    lacks = {route: F.coalesce(*(F.when((_given(p) if p in NUMERIC else _param(p)).isNull(), F.lit(p)) for p in needed)) for route, (_, _, _, needed) in ROUTES.items() if needed and route != "download"}
    missing = _case(lacks, F.lit(None).cast("string"))
    floats = {route: F.coalesce(*(F.when(_given(p).isNotNull() & _given(p).try_cast("double").isNull(), F.lit(p)) for p in of)) for route, of in FLOATS.items()}
    paged = F.col("operation").isin(*PAGED) & _given("page").isNotNull() & pagespec.integer(_given("page")).isNull()
    unreadable = _case(floats, F.lit(None).cast("string")).isNotNull() | paged
    bad_list = F.when(F.col("operation").isin("extract", "remove"), pagespec.list_cause(_param("pages")))

    n = F.col("n_pages")
    off = F.when(~_page().between(F.lit(1), n), F.lit(INVALID_PAGE))
    cause = _case(
        {
            "split": pagespec.groups_cause(_param("groups")),
            "watermark": F.when(n > 0, overlays.stamp_cause(_param("text"), _number("opacity", 0.3))),
            "add-text": F.coalesce(off, drawing.lacking(_param("text"), drawing.font(_param("fontName")))),
            "add-signature": F.coalesce(off, F.when(images.size(F.col("image")).isNull(), F.lit(NO_IMAGE))),
            "redact": off,
            "redact-multiple": F.when(overlays.boxes(_param("redactions")).isNull(), F.lit(overlays.MALFORMED_BOXES)),
        },
        F.lit(None).cast("string"),
    )
    cause = F.coalesce("unread", cause)
    failed = _case({route: F.lit(f"{results.FAILED[told]}: ") for route, (told, *_) in ROUTES.items()}, F.lit(""))
    verdict = names.verdict(_param("filename"))
    refused = F.when(~files, F.when(verdict != "OK", verdict).when(F.col("found").isNull(), F.concat(F.lit(NOT_FOUND), _param("filename"))))

    groups = F.when(F.col("operation") == "split", pagespec.groups(_param("groups"), n))
    single = F.coalesce(F.regexp_replace(_param("groups"), r"[\x00-\x20]", "") == "", F.lit(True))
    numbers = F.filter(F.transform(groups, lambda g, k: F.when(F.size(g) > 0, k + 1)), lambda k: k.isNotNull())
    # what was found is columns from here on, so that no expression holds another's whole tree twice
    r = r.withColumns({"too_large": too_large, "no_file": no_file, "missing": missing, "unreadable": unreadable, "bad_list": bad_list, "cause": cause, "refused": refused, "numbers": numbers, "single": single})
    kind = (
        F.when(~F.col("operation").isin(*ROUTES), F.lit("other")).when(F.col("too_large"), F.lit("too_large")).when(F.col("no_file"), F.lit("other")).when(F.col("missing").isNotNull(), F.lit("missing"))
        .when(F.col("unreadable"), F.lit("other")).when(F.col("bad_list").isNotNull(), F.lit("bad_input")).when(F.col("refused").isNotNull() | files & F.col("cause").isNotNull(), F.lit("failed")).otherwise(F.lit("done"))
    )
    part = F.transform("numbers", lambda k: F.when(F.col("single"), names.part_name(F.col("name"), "page", k, F.col("job_id"))).otherwise(names.part_name(F.col("name"), "part", k, F.col("job_id"))))
    outputs = {route: F.array(names.output_name(F.col("name"), suffix, extension, F.col("job_id"))) for route, (_, suffix, extension, _) in ROUTES.items() if suffix}
    outputs |= {"split": part, "download": F.array("filename")}
    done = {route: F.lit(results.DONE.get(told)) for route, (told, *_) in ROUTES.items()}
    done |= {"split": F.concat(F.lit("PDF split into "), F.size("numbers").cast("string"), F.lit(" documents")), "info": F.concat(F.lit("Pages: "), n.cast("string")), "download": F.lit("OK")}
    judged = r.withColumn("kind", kind)
    detail = (
        F.when(F.col("kind") == "missing", F.col("missing")).when(F.col("kind") == "bad_input", F.col("bad_list")).when(F.col("kind") == "done", _case(done, F.lit("")))
        .when(F.col("kind") == "failed", F.coalesce("refused", F.concat(failed, "cause")))
    )
    none = F.array().cast("array<string>")
    judged = judged.withColumns({"detail": F.coalesce(detail, F.lit("")), "outputs": F.when(F.col("kind") == "done", _case(outputs, none)).otherwise(none)})
    o = results.outcome(F.col("kind"), F.col("detail"))
    return judged.select("job_id", "doc_id", "operation", o["status"].alias("status"), o["success"].alias("success"), o["message"].alias("message"), "outputs")
