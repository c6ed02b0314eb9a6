import pytest
from pyspark.sql import functions as F

from pagefold.functions import pagespec
from pagefold.operators import pages
from pagefold.plans import catalog

SPECS = [
    ("1-3", 5, [1, 2, 3]), ("1,2,5", 5, [1, 2, 5]), ("1-3,5", 5, [1, 2, 3, 5]), ("5,1-3", 5, [5, 1, 2, 3]), ("3,3,1", 5, [3, 1]), ("5-3", 5, []), ("0-2", 5, [1, 2]), ("4-99", 5, [4, 5]),
    ("1-2-3", 5, [1, 2]), ("1,2,,", 5, [1, 2]), (" 2 , 4 - 5 ", 5, [2, 4, 5]), ("99", 5, []), (",", 5, []), ("1-3", 0, []),
    ("-3", 5, None), ("3-", 5, None), ("1,,2", 5, None), ("x", 5, None), ("x-2", 5, None), ("5-x", 3, None), ("", 5, None), (" ", 5, None),
]


@pytest.mark.parametrize("spec, n, want", SPECS)
def test_group(spark, spec, n, want):
    assert spark.range(1).select(pagespec.group(F.lit(spec), F.lit(n)).alias("g")).first()["g"] == want


@pytest.mark.parametrize("spec, n, want", [("1-2,4;99;9,3;1", 9, [[1, 2, 4], [], [9, 3], [1]]), (";", 3, []), (None, 3, [[1], [2], [3]]), (" ", 2, [[1], [2]]), ("1;;2", 3, None), ("1;", 3, [[1]]), (None, 0, [])])
def test_groups(spark, spec, n, want):
    assert spark.range(1).select(pagespec.groups(F.lit(spec).cast("string"), F.lit(n)).alias("g")).first()["g"] == want


@pytest.mark.parametrize("chosen, n, want", [([2, 4], 5, [1, 3, 5]), ([2, 2], 5, [1, 4, 5]), ([5, 5], 5, [1, 2, 3, 4]), ([2, 2, 3], 5, [1, 5]), ([10, 0, -1], 3, [1, 2, 3]), ([1, 1, 1, 1], 3, []), ([1], 0, [])])
def test_left_after(spark, chosen, n, want):
    assert spark.range(1).select(pagespec.left_after(F.array(*map(F.lit, chosen)), F.lit(n)).alias("g")).first()["g"] == want


def test_ints_and_ranges(spark):
    r = spark.range(1).select(*(f(F.lit(s)).alias(f"c{k}") for k, (f, s) in enumerate([(pagespec.ints, "3, 1,3"), (pagespec.ints, "5-7"), (pagespec.ints, ","), (pagespec.ranges, "5-7,1,x,3-2,1")]))).first()
    assert list(r) == [[3, 1, 3], None, [], [1, 5, 6, 7]]


@pytest.mark.parametrize("spec, want", [("2,1-3", 3), ("2,1-100000", 100_000), ("2,1-100001", None), ("9,x,3-2,,7-8,8-12,1,1", 7), ("1-5,2-3,7", 6), ("5-7,1-9,2147483647", 10), ("2147483648,0,-3", 0), ("0-4, 2 ", 1), ("", 0), (None, None)])
def test_range_count(spark, spec, want):
    text = F.lit(spec).cast("string")
    n, pages_ = spark.range(1).select(pagespec.range_count(text), pagespec.ranges(text)).first()
    assert n == want and (pages_ is None if want is None else len(pages_) == want and pages_ == sorted(set(pages_)))


def test_wide_ranges_are_counted_not_unfolded(spark, tmp_path):
    spark.range(30_000).withColumnRenamed("id", "event_id").write.parquet(f"{tmp_path}/events.parquet")
    out = catalog.wide_ranges(spark, str(tmp_path))
    assert "sequence(" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {tuple(r) for r in out.groupBy("fails", "n").count().collect()} == {(False, 3, 10_000), (True, -1, 10_000), (False, 100_000, 10_000)}


@pytest.fixture
def five(spark):
    return spark.createDataFrame([(d, p, f"{d}.{p}") for d, n in ((1, 5), (2, 3)) for p in range(1, n + 1)], "doc_id long, page_no int, text string")


def test_split_then_merge_is_the_document(spark, five):
    parts = pages.split_pages(five).filter("doc_id = 1").select((F.col("part_no") + 100).cast("long").alias("doc_id"), F.lit(1).alias("page_no"), "text")
    files = parts.select(F.lit(7).alias("job_id"), (F.col("doc_id") - 100).alias("pos"), "doc_id")
    assert [r["text"] for r in pages.merge(parts, files).orderBy("out_page").collect()] == [f"1.{k}" for k in range(1, 6)]


def test_extract_and_remove_are_all_pages(spark, five):
    chosen = pages.selection(spark, [(1, 2), (2, 4)], "pos int, page_no int")
    out = pages.extract(five, chosen).select("doc_id", "src_page").union(pages.remove(five, chosen.select("page_no")).select("doc_id", "src_page"))
    assert sorted(map(tuple, out.collect())) == sorted((r["doc_id"], r["page_no"]) for r in five.collect())


def test_extract_keeps_order_and_duplicates(spark, five):
    out = pages.extract(five, pages.selection(spark, [(1, 3), (2, 1), (3, 3), (4, 10)], "pos int, page_no int")).filter("doc_id = 2").orderBy("out_page")
    assert [r["src_page"] for r in out.collect()] == [3, 1, 3]


def test_malformed_groups_fail(spark):
    with pytest.raises(ValueError):
        pages.stated_groups(spark, "1;;2", 5)


def test_merge_of_one_file_twice(spark, five):
    files = spark.createDataFrame([(1, 1, 2), (1, 2, 2)], "job_id int, pos int, doc_id long")
    assert pages.merge(five, files).count() == 6


def test_exclusive_groups(spark):
    clicks = spark.createDataFrame([(1, 1, "a", 1), (1, 2, "b", 1), (1, 3, "b", 2), (1, 4, "b", 2), (1, 5, "a", 3), (1, 6, "b", 3), (1, 7, "a", 3)], "doc_id int, seq int, group_id string, page_no int")
    assert sorted(map(tuple, pages.exclusive(clicks).collect())) == [(1, 1, "b"), (1, 3, "a")]


@pytest.mark.parametrize("move, want", [((0, 2), [2, 3, 1, 4]), ((3, 0), [4, 1, 2, 3]), ((9, 0), [1, 2, 3, 4]), ((1, 1), [1, 2, 3, 4])])
def test_reordered(spark, move, want):
    files = spark.createDataFrame([(1, p, p) for p in range(1, 5)], "job_id int, pos int, doc_id int")
    assert [r["doc_id"] for r in pages.reordered(files, *move).orderBy("pos").collect()] == want
