"""Sets of page numbers as arrays of intervals, struct(lo, hi) of longs: of any width, unfolded only where pages exist.

A set in normal form is ascending, and its intervals neither meet nor touch. The folds copy what they have gathered at each
new interval, so they cost the square of an array's intervals, never of its pages.
"""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

INTERVALS = "array<struct<lo:bigint,hi:bigint>>"


def interval(lo: Column, hi: Column) -> Column:
    return F.struct(lo.cast("long").alias("lo"), hi.cast("long").alias("hi"))


def empty() -> Column:
    return F.array().cast(INTERVALS)


def of_pages(pages: Column) -> Column:
    """An array of pages, in its order and with its duplicates, as intervals of one page each."""
    return F.transform(pages, lambda p: interval(p, p))


def _gathered(a: Column, body: Callable[[Column, Column], Column]) -> Column:
    """Each interval of a, as body makes it of the last one gathered (null at first) and itself, put into that one where
    they touch."""

    def add(out: Column, i: Column) -> Column:
        last = F.try_element_at(out, F.lit(-1))
        new = body(last, i)
        both = F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(interval(last["lo"], F.greatest(last["hi"], new["hi"]))))
        return F.when(last.isNotNull() & (new["lo"] <= last["hi"] + 1), both).otherwise(F.concat(out, F.array(new)))

    return F.aggregate(a, empty(), add)


def merged(a: Column) -> Column:
    """Normal form; intervals that end before they begin are empty."""
    return _gathered(F.array_sort(F.filter(a, lambda i: i["lo"] <= i["hi"])), lambda last, i: i)


def union(a: Column, b: Column) -> Column:
    return merged(F.concat(a, b))


def within(a: Column, n: Column) -> Column:
    """What lies in 1..n of each interval, in order; those with nothing there are left out."""
    clipped = F.transform(a, lambda i: interval(F.greatest(i["lo"], F.lit(1)), F.least(i["hi"], n.cast("long"))))
    return F.filter(clipped, lambda i: i["lo"] <= i["hi"])


def gaps(a: Column, n: Column) -> Column:
    """1..n without a set in normal form, which lies in 1..n itself."""
    lo = lambda k: F.coalesce(F.get(a, k - 1)["hi"] + 1, F.lit(1))
    hi = lambda k: F.coalesce(F.get(a, k)["lo"] - 1, n.cast("long"))
    return F.filter(F.transform(F.sequence(F.lit(0), F.size(a)), lambda k: interval(lo(k), hi(k))), lambda i: i["lo"] <= i["hi"])


def count(a: Column) -> Column:
    return F.aggregate(a, F.lit(0).cast("long"), lambda n, i: n + i["hi"] - i["lo"] + 1)


def covered(a: Column) -> Column:
    """The pages in intervals of any order that may meet, each counted once; what they cost is sorting them."""
    begin = F.struct(F.lit(None).cast("long").alias("last"), F.lit(0).cast("long").alias("n"))

    def add(s: Column, i: Column) -> Column:
        new = F.greatest(i["hi"] - F.greatest(i["lo"] - 1, s["last"]), F.lit(0).cast("long"))
        return F.struct(F.greatest(s["last"], i["hi"]).alias("last"), (s["n"] + new).alias("n"))

    return F.aggregate(F.array_sort(a), begin, add, lambda s: s["n"])


def holds(a: Column, page: Column) -> Column:
    return F.exists(a, lambda i: page.between(i["lo"], i["hi"]))


def parked(pages: Column) -> Column:
    """What goes if pages are deleted one by one, highest first, each by its place among those then left, in normal form:
    k copies of a page take the first k from it on that are left, so that each takes the least place from it on which is
    still free, in whatever order they come. pages: ascending, from 1. What lies beyond the last page takes nothing."""
    return _gathered(of_pages(pages), lambda last, i: interval(F.greatest(i["lo"], F.coalesce(last["hi"] + 1, F.lit(1))), F.greatest(i["hi"], F.coalesce(last["hi"] + 1, F.lit(1)))))


def numbered(a: Column) -> Column:
    """struct(lo, hi, before): with the pages that stand before each interval, in order."""
    kind = "array<struct<lo:bigint,hi:bigint,before:bigint>>"

    def add(out: Column, i: Column) -> Column:
        last = F.try_element_at(out, F.lit(-1))
        before = F.coalesce(last["before"] + last["hi"] - last["lo"] + 1, F.lit(0).cast("long"))
        return F.concat(out, F.array(F.struct(i["lo"].alias("lo"), i["hi"].alias("hi"), before.alias("before"))))

    return F.aggregate(a, F.array().cast(kind), add)
