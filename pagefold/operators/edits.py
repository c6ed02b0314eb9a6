"""Chains of edits as one permutation: the steps of each job are folded into runs of pages, and pages are looked up once.

steps: job_id, step (the order), op and what that needs:

    merge        doc_id: all its pages at the end
    extract      spec, integers: those places, in their order and with duplicates
    remove       spec, integers: all but those places
    remove_each  spec, integers: one by one, highest first, each by its place among those then left
    move         start, target (from 0): the page at one place to another; out of bounds nothing moves
    drop         start (from 0): without the page there; out of bounds none goes

Places are those of what the step before left. A job's state is a list of runs struct(doc_id, lo, hi), so a step costs the
runs that it cuts, never pages. A job's own steps are folded by one task: they are what somebody asked for, one after the
other, not data that grows.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagefold.functions import intervals, pagespec
from pagefold.operators.pages import page_counts
from pagefold.operators.results import DONE, FAILED

RUNS = "array<struct<doc_id:bigint,lo:bigint,hi:bigint>>"
STEP = {"op": "string", "spec": "string", "start": "long", "target": "long", "doc_id": "long"}
#: Whose message a failed step has.
TOLD = {"merge": "merge", "extract": "extract", "remove": "remove", "remove_each": "remove"}
NO_DOCUMENT = "no such document"
UNKNOWN = "unknown step"


def _laid(runs: Column) -> Column:
    """With before: the pages in front of each run."""
    kind = "array<struct<doc_id:bigint,lo:bigint,hi:bigint,before:bigint>>"

    def add(out: Column, r: Column) -> Column:
        last = F.try_element_at(out, F.lit(-1))
        before = F.coalesce(last["before"] + last["hi"] - last["lo"] + 1, F.lit(0).cast("long"))
        return F.concat(out, F.array(F.struct(r["doc_id"].alias("doc_id"), r["lo"].alias("lo"), r["hi"].alias("hi"), before.alias("before"))))

    return F.aggregate(runs, F.array().cast(kind), add)


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def picked(runs: Column, places: Column) -> Column:
    """What lies at each interval of places (from 1, within the runs), in order."""

    def cut(i: Column, laid: Column) -> Column:
        own = F.transform(laid, lambda r: F.struct(r["doc_id"].alias("doc_id"), F.greatest(r["lo"], r["lo"] + i["lo"] - 1 - r["before"]).alias("lo"), F.least(r["hi"], r["lo"] + i["hi"] - 1 - r["before"]).alias("hi")))
        return F.filter(own, lambda r: r["lo"] <= r["hi"])

    return _let(_laid(runs), lambda laid: F.flatten(F.transform(places, lambda i: cut(i, laid))))


def _chosen(s: Column, n: Column) -> Column:
    """The places that a step keeps of n, in order; null where it is malformed."""
    one = lambda lo, hi: intervals.interval(lo, hi)
    some = lambda *v: F.filter(F.array(*v), lambda i: i["lo"] <= i["hi"])
    listed = F.filter(pagespec.ints(s["spec"]), lambda p: (p >= 1) & (p <= n))
    start, target, first = s["start"], s["target"], F.lit(1)
    inside = lambda v: F.coalesce((v >= 0) & (v < n), F.lit(False))
    forth = some(one(first, start), one(start + 2, target + 1), one(start + 1, start + 1), one(target + 2, n))
    back = some(one(first, target), one(start + 1, start + 1), one(target + 1, start), one(start + 2, n))
    whole = some(one(first, n))
    return (
        F.when(s["op"] == "extract", intervals.of_pages(listed))
        .when(s["op"] == "remove", intervals.gaps(intervals.merged(intervals.of_pages(listed)), n))
        .when(s["op"] == "remove_each", intervals.gaps(intervals.within(intervals.parked(F.array_sort(listed)), n), n))
        .when(s["op"] == "move", F.when(~inside(start) | ~inside(target) | (start == target), whole).when(start < target, forth).otherwise(back))
        .when(s["op"] == "drop", F.when(inside(start), some(one(first, start), one(start + 2, n))).otherwise(whole))
    )


def _cause(s: Column) -> Column:
    number = pagespec.list_cause(F.coalesce(s["spec"], F.lit("")))
    return F.when(s["op"] == "merge", F.lit(NO_DOCUMENT)).when(s["op"].isin("extract", "remove", "remove_each"), number).otherwise(F.lit(UNKNOWN))


def composed(steps: DataFrame, pages: DataFrame) -> DataFrame:
    """job_id, runs (null if the job fails), n_pages, and the first step that fails with its op and cause. Equal steps of a
    job stand in order of their other columns; a null op is unknown."""
    counts = page_counts(pages).select("doc_id", F.col("page_count").cast("long").alias("n"))
    have = {c: (F.col(c) if c in steps.columns else F.lit(None)).cast(kind).alias(c) for c, kind in STEP.items()}
    known = steps.select("job_id", F.col("step").cast("long").alias("step"), *have.values()).join(counts, "doc_id", "left")
    row = F.struct("step", *STEP, "n")
    jobs = known.groupBy("job_id").agg(F.array_sort(F.collect_list(row)).alias("steps"))

    def state(runs: Column, n: Column, failed: Column | None = None) -> Column:
        """failed: the step that can't be taken; runs and n are then those before it."""
        told = [F.lit(None)] * 3 if failed is None else [failed["step"], failed["op"], _cause(failed)]
        return F.struct(runs.cast(RUNS).alias("runs"), n.cast("long").alias("n"), F.lit(failed is not None).alias("failed"), *(v.cast(k).alias(c) for v, (c, k) in zip(told, (("step", "long"), ("op", "string"), ("cause", "string")), strict=True)))

    def fold(a: Column, s: Column) -> Column:
        failed = state(a["runs"], a["n"], s)
        more = state(F.concat(a["runs"], F.array(F.struct(s["doc_id"].alias("doc_id"), F.lit(1).cast("long").alias("lo"), s["n"].alias("hi")))), a["n"] + s["n"])
        kept = _let(_chosen(s, a["n"]), lambda c: F.when(c.isNull(), failed).otherwise(state(picked(a["runs"], c), intervals.count(c))))
        return F.when(a["failed"], a).when(F.coalesce(s["op"], F.lit("")) == "merge", F.when(s["n"].isNull(), failed).otherwise(more)).otherwise(kept)

    done = jobs.select("job_id", F.aggregate("steps", state(F.array(), F.lit(0)), fold).alias("s"))
    fine = lambda c: F.when(~F.col("s.failed"), F.col(c))
    return done.select("job_id", fine("s.runs").alias("runs"), fine("s.n").alias("n_pages"), F.col("s.step").alias("step"), F.col("s.op").alias("op"), F.col("s.cause").alias("cause"))


def edited(pages: DataFrame, jobs: DataFrame) -> DataFrame:
    """jobs: composed(). The pages of each job: job_id, out_page, src_doc, src_page and the rest of the page. However many
    steps there were, runs are unfolded where pages exist and joined with them once."""
    runs = jobs.filter("runs is not null").select("job_id", F.explode(_laid(F.col("runs"))).alias("r"))
    each = runs.select("job_id", "r.*", F.explode(F.sequence("r.lo", "r.hi")).alias("page_no"))
    places = each.select("job_id", "doc_id", F.col("page_no").cast(pages.schema["page_no"].dataType).alias("page_no"), (F.col("before") + F.col("page_no") - F.col("lo") + 1).cast("int").alias("out_page"))
    joined = places.join(pages, ["doc_id", "page_no"])
    return joined.select("job_id", "out_page", F.col("doc_id").alias("src_doc"), F.col("page_no").alias("src_page"), *(c for c in pages.columns if c not in ("doc_id", "page_no")))


def edit_outcomes(jobs: DataFrame) -> DataFrame:
    """jobs: composed(). job_id, success, n_pages, message."""
    failed = F.coalesce(*(F.when(F.col("op") == op, F.lit(FAILED[told])) for op, told in TOLD.items()), F.lit(FAILED["merge"]))
    ok = F.col("runs").isNotNull()
    return jobs.select("job_id", ok.alias("success"), "n_pages", F.when(ok, F.lit(DONE["merge"])).otherwise(F.concat(failed, F.lit(": "), "cause")).alias("message"))
