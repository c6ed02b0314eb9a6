"""Sinks that commit, lookups that stay in their folder, limits of whole requests."""

import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagefold.functions import names
from pagefold.operators import results
from pagefold.sources import batches, committed, files


def made(spark, rows):
    return spark.createDataFrame([(n, None if c is None else bytearray(c)) for n, c in rows], "name string, content binary")


def left_in(folder):
    return sorted(os.path.join(d, f).removeprefix(f"{folder}/") for d, _, fs in os.walk(folder) for f in fs)


def test_files_appear_when_the_job_commits(spark, tmp_path):
    folder = f"file://{tmp_path}/out"
    committed.write_files(made(spark, [(f"f{k}.pdf", b"x" * k) for k in range(40)] + [("empty.md", None)]).repartition(6), folder)
    got = {r["name"]: r["length"] for r in files.loaded(spark, folder, "*").collect()}
    assert got == {f"f{k}.pdf": k for k in range(1, 40)}  # Spark lists no empty files
    assert not any("_staged" in x for x in left_in(f"{tmp_path}/out"))
    committed.write_files(made(spark, [("g.pdf", b"1")]), folder)
    assert files.listed(spark, folder, "*").count() == 40 and len(left_in(f"{tmp_path}/out")) == 42


@pytest.mark.parametrize("bad", ["../up.pdf", "", "_hidden", "f1.pdf"])
def test_a_failing_task_leaves_nothing(spark, tmp_path, bad):
    folder = f"file://{tmp_path}/out"
    rows = made(spark, [(f"f{k}.pdf", b"x") for k in range(30)] + [(bad, b"y")]).coalesce(1) if bad == "f1.pdf" else made(spark, [(f"f{k}.pdf", b"x") for k in range(30)] + [(bad, b"y")]).repartition(5)
    with pytest.raises(Exception, match="file name|one name"):
        committed.write_files(rows, folder)
    # a task that still ran when the job was given up may have staged files, which no reader sees
    assert [x for x in left_in(f"{tmp_path}/out") if not x.startswith(committed.HIDDEN)] == []


def test_downloads_stay_in_their_folder(spark, tmp_path):
    root = tmp_path / "a b"
    root.mkdir()
    (tmp_path / "secret.pdf").write_bytes(b"secret")
    (root / "fine.pdf").write_bytes(b"fine")
    os.symlink(tmp_path / "secret.pdf", root / "out.pdf")
    os.symlink(root / "fine.pdf", root / "in.pdf")
    asked = spark.createDataFrame([(n,) for n in ("fine.pdf", "out.pdf", "in.pdf", "none.pdf", "../secret.pdf", None, "fine.pdf")], "name string")
    got = sorted(((r["name"], r["verdict"], r["content"] and bytes(r["content"])) for r in files.download(spark, asked, f"file://{root}").collect()), key=repr)
    assert got == sorted([
        ("fine.pdf", "OK", b"fine"), ("fine.pdf", "OK", b"fine"), ("in.pdf", "OK", b"fine"), ("out.pdf", "Access denied: file is outside the allowed directory", None), ("none.pdf", "File not found: none.pdf", None),
        ("../secret.pdf", names.SEPARATOR, None), (None, names.EMPTY, None),
    ], key=repr)


def test_downloads_hold_few_files_at_a_time(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"a")
    plan = files.download(spark, spark.createDataFrame([("a.pdf",)], "name string"), f"file://{tmp_path}")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "ArrowEvalPython" not in plan  # a UDF would hold the files of 10,000 rows
    kind, seen = pa.schema([("c", pa.binary())]), []
    rows = (seen.append(k) or ({"c": bytes(n)}, n) for k, n in enumerate([10, 60, 50, 200, *[1] * 5]))
    made_ = [(b.num_rows, len(seen)) for b in batches.gathered(rows, kind, most_bytes=100, most_rows=3)]
    assert made_ == [(3, 3), (1, 4), (3, 7), (2, 9)]
    assert [b.num_rows for b in batches.pieces([pa.record_batch({"c": range(5)}), pa.record_batch({"c": range(2)})], 2)] == [2, 2, 1, 2]


def test_paths_with_dots(spark, tmp_path):
    paths = [(f"file://{tmp_path}/x/../y.pdf", True), (f"file://{tmp_path}/../y.pdf", False), (f"file://{tmp_path}", False), (f"file://{tmp_path}2/y.pdf", False)]
    got = files.resolved(spark.createDataFrame(paths, "path string, want boolean"), f"file://{tmp_path}").collect()
    assert [r["inside"] for r in got] == [w for _, w in paths]
    other = files.resolved(spark.createDataFrame([("s3://b/root/a/../c",), ("s3://b/root/../c",)], "path string"), "s3://b/root").collect()
    assert [r["inside"] for r in other] == [True, False]


def test_limits_of_requests(spark):
    rows = [(1, 60), (1, 50), (2, 101), (3, 100), (4, None), (None, 200), (5, 50), (5, 50)]
    df = spark.createDataFrame(rows, "job_id int, length long")
    kept = sorted((r["job_id"], r["length"]) for r in files.limited(df, 100, 100).filter("not refused").collect() if r["length"] is not None)
    assert kept == [(3, 100), (5, 50), (5, 50)]
    told = {r["job_id"]: (r["status"], r["n_files"], r["n_bytes"], r["message"]) for r in files.refused(df, 100, 100).collect()}
    assert told == {1: (413, 2, 110, results.TOO_LARGE), 2: (413, 1, 101, results.TOO_LARGE), 3: (200, 1, 100, "OK"), 4: (200, 1, 0, "OK"), None: (413, 1, 200, results.TOO_LARGE), 5: (200, 2, 100, "OK")}


def test_names_that_meet(spark):
    rows = [(1, 1, "a", "x"), (1, 2, "a", "y"), (2, 1, "a", "z"), (1, 3, "b", None), (3, 1, None, "w"), (1, 2, "a", "y")]
    df = spark.createDataFrame(rows, "job_id int, pos int, name string, more string")
    assert sorted(map(tuple, names.settled(df, ["job_id", "pos"]).collect())) == [(1, 3, "b", None, 1), (2, 1, "a", "z", 4)]
    assert [tuple(r) for r in names.clashes(df).collect()] == [(1, "a", 3)]
    named = spark.range(1).select(names.part_name(F.lit("in/a.PDF"), "page", F.lit(3), F.lit(7)).alias("a"), names.part_name(F.lit(None).cast("string"), "part", F.lit(3), F.lit(7)).alias("b"), names.part_name(F.lit("a.pdf"), "part", F.lit(3)).alias("c")).first()
    assert named["a"].startswith("a_split_page3_") and named["b"].startswith("split_part3_") and named["a"][-12:] != named["b"][-12:]
    assert len(named["c"]) == len("a_split_part3_01234567.pdf")
