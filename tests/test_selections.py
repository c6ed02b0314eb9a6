"""Selections of their own for each request, and sets of intervals, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from pagefold.functions import intervals, pagespec
from pagefold.operators import pages, selections

SIZES = {1: 5, 2: 3, 3: 12, 4: 1}


def evaluated(spark, rows, kind, **columns):
    return [r.asDict() for r in spark.createDataFrame(rows, kind).coalesce(1).select("k", *(c.alias(n) for n, c in columns.items())).orderBy("k").collect()]


def numbers(a):
    return None if a is None else [p for i in a for p in range(i["lo"], i["hi"] + 1)]


def random_sets(seed, n=150):
    r = random.Random(seed)
    return [(k, [(lo, lo + r.randint(-2, 6)) for lo in (r.randint(-3, 30) for _ in range(r.randint(0, 8)))], r.randint(0, 30)) for k in range(n)]


def test_interval_sets(spark):
    rows = random_sets(1)
    a, n = F.col("a"), F.col("n")
    normal = intervals.within(intervals.merged(a), n)
    got = evaluated(spark, rows, f"k int, a {intervals.INTERVALS}, n int", m=intervals.merged(a), size=intervals.count(intervals.merged(a)), w=normal, g=intervals.gaps(normal, n), six=intervals.holds(a, F.lit(6)), u=intervals.union(a, F.array(intervals.interval(F.lit(2), F.lit(9)))), at=intervals.numbered(normal))
    for (_, given, top), r in zip(rows, got, strict=True):
        want = {p for lo, hi in given for p in range(lo, hi + 1)}
        assert numbers(r["m"]) == sorted(want) and r["size"] == len(want) and r["six"] == (6 in want)
        assert all(x["hi"] + 1 < y["lo"] for x, y in zip(r["m"], r["m"][1:]))
        assert numbers(r["w"]) == sorted(p for p in want if 1 <= p <= top)
        assert numbers(r["g"]) == [p for p in range(1, top + 1) if p not in want]
        assert numbers(r["u"]) == sorted(want | set(range(2, 10)))
        assert [x["before"] for x in r["at"]] == [sum(y["hi"] - y["lo"] + 1 for y in r["at"][:k]) for k in range(len(r["at"]))]


@pytest.mark.parametrize("text, want", [("1-2000000000", [(1, 2_000_000_000)]), ("5-7,1,x,3-2,1", [(1, 1), (5, 7)]), ("3,1-2,4-9", [(1, 9)]), ("-3,0,2-", []), ("9-99999999999999999,7", [(7, 7), (9, 99_999_999_999_999_999)]), ("9" * 40, []), ("", []), (" 4 , 6 - 5,8 - 9", [(4, 4), (8, 9)])])
def test_range_sets(spark, text, want):
    got = spark.range(1).select(pagespec.range_set(F.lit(text)).alias("s")).first()["s"]
    assert [tuple(i) for i in got] == want


def one_by_one(n, listed):
    left = list(range(1, n + 1))
    for p in sorted(listed, reverse=True):
        if 0 < p <= len(left):
            del left[p - 1]
    return left


def test_deleting_one_by_one(spark):
    r = random.Random(4)
    rows = [(k, sorted(r.randint(1, 15) for _ in range(r.randint(0, 12))), r.randint(0, 14)) for k in range(300)]
    got = evaluated(spark, rows, "k int, p array<int>, n int", g=intervals.gaps(intervals.within(intervals.parked(F.col("p")), F.col("n")), F.col("n")))
    assert [numbers(x["g"]) for x in got] == [one_by_one(n, p) for _, p, n in rows]


@pytest.fixture
def book(spark):
    return spark.createDataFrame([(d, p, f"{d}.{p}") for d, n in SIZES.items() for p in range(1, n + 1)], "doc_id long, page_no int, text string")


def requests(spark, specs):
    return spark.createDataFrame([(k, 1 + k % 5, s) for k, s in enumerate(specs)], "job_id long, doc_id long, spec string")


LISTS = ["1", "3,1,3", " 2 , 99", "5-7", ",", "", None, "2,2", "1,1,1,1,1,1", "-1,0,1", "12,3,3,3,12", "x,1", "2,", "+4", "1,,2"] * 3


def plain_list(s):
    try:
        return None if s is None else [int(x) for x in (s.rstrip(",") if s.strip(",") or not s else "").split(",") if s.strip(",") or not s]
    except ValueError:
        return None


def test_own_lists(spark, book):
    asked = requests(spark, LISTS)
    want, kept, each, fine = [], [], [], {}
    for k, s in enumerate(LISTS):
        d = 1 + k % 5
        listed, n = plain_list(s), SIZES.get(d, 0)
        fine[k] = None if listed is None else [sum(1 <= p <= n for p in listed), n - len({p for p in listed if 1 <= p <= n}), len(one_by_one(n, listed))]
        if listed is None:
            continue
        want += [(k, i, d, p, f"{d}.{p}") for i, p in enumerate((p for p in listed if 1 <= p <= n), 1)]
        kept += [(k, i, d, p, f"{d}.{p}") for i, p in enumerate((p for p in range(1, n + 1) if p not in listed), 1)]
        each += [(k, i, d, p, f"{d}.{p}") for i, p in enumerate(one_by_one(n, listed), 1)]
    assert sorted(map(tuple, selections.extracted(book, asked).collect())) == sorted(want)
    assert sorted(map(tuple, selections.left(book, asked).collect())) == sorted(kept)
    assert sorted(map(tuple, selections.left(book, asked, one_by_one=True).collect())) == sorted(each)
    for i, kind in enumerate(("extract", "remove", "remove_each")):
        got = {r["job_id"]: r for r in selections.outcomes(book, asked, kind).collect()}
        assert {k: r["n_pages"] for k, r in got.items()} == {k: None if v is None else v[i] for k, v in fine.items()}
        assert all(r["success"] == (r["cause"] is None) == (fine[k] is not None) for k, r in got.items())
    assert got[3]["cause"] == 'For input string: "5-7"' and got[14]["cause"] == 'For input string: ""' and got[11]["cause"] == 'For input string: "x"'


def test_own_groups(spark, book):
    asked = requests(spark, ["1-2,4;99;9,3;1", None, ";", "1;;2", "3-1000000", " ", "2;2;1", "x", "1-2000000000", "5-4;1"])
    whole = {d: list(range(1, n + 1)) for d, n in SIZES.items()} | {5: []}
    own = {0: [[1, 2, 4], [], [3], [1]], 1: [[1], [2], [3]], 2: [], 4: [[]], 5: [[p] for p in whole[1]], 6: [[2], [2], [1]], 8: [whole[4]], 9: [[], []]}
    want = sorted((k, g, i, 1 + k % 5, p, f"{1 + k % 5}.{p}") for k, groups in own.items() for g, group in enumerate(groups, 1) for i, p in enumerate(group, 1) if 1 + k % 5 in SIZES)
    got = sorted((r["job_id"], r["part_no"], r["out_page"], r["doc_id"], r["src_page"], r["text"]) for r in selections.parts(book, asked).collect())
    assert got == want
    out = {r["job_id"]: r["n_pages"] for r in selections.outcomes(book, asked, "split").collect()}
    assert out == {k: None if k in (3, 7) else sum(w[0] == k for w in want) for k in range(10)}
    named = {k: set() if k in (1, 5) else {p for g in groups for p in g} for k, groups in own.items()}
    free = sorted((k, 1 + k % 5, p) for k, s in named.items() for p in whole[1 + k % 5] if p not in s)
    assert sorted(map(tuple, selections.unassigned(book, asked).collect())) == free


def test_no_requests_and_no_pages(spark, book):
    none, blank = requests(spark, ["1"]).filter("job_id < 0"), book.filter("doc_id < 0")
    assert selections.extracted(book, none).count() == selections.left(blank, requests(spark, ["1"])).count() == 0
    assert [tuple(r) for r in selections.outcomes(blank, requests(spark, ["1"]), "extract").collect()] == [(0, 1, True, 0, None)]
    assert pages.page_counts(blank).count() == 0
