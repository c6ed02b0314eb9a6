"""Chains of edits against plain lists, step by step."""

import random

import pytest

from pagefold.operators import edits

SIZES = {1: 5, 2: 1, 3: 9}
KIND = "job_id long, step int, op string, spec string, start long, target long, doc_id long"


@pytest.fixture
def book(spark):
    return spark.createDataFrame([(d, p, f"{d}.{p}") for d, n in SIZES.items() for p in range(1, n + 1)], "doc_id long, page_no int, text string")


def plainly(steps):
    now = []
    for op, spec, start, target, doc in steps:
        listed = None if spec is None else [int(x) for x in spec.split(",")]
        if op == "merge":
            now = now + [(doc, p) for p in range(1, SIZES[doc] + 1)]
        elif op == "extract":
            now = [now[p - 1] for p in listed if 1 <= p <= len(now)]
        elif op == "remove":
            now = [x for k, x in enumerate(now, 1) if k not in listed]
        elif op == "remove_each":
            for p in sorted(listed, reverse=True):
                if 0 < p <= len(now):
                    now = now[: p - 1] + now[p:]
        elif op == "move" and 0 <= start < len(now) and 0 <= target < len(now):
            x = now[start]
            now = now[:start] + now[start + 1 :]
            now = now[:target] + [x] + now[target:]
        elif op == "drop" and 0 <= start < len(now):
            now = now[:start] + now[start + 1 :]
    return now


def random_steps(r):
    op = r.choice(["merge", "merge", "extract", "remove", "remove_each", "move", "move", "drop"])
    if op == "merge":
        return op, None, None, None, r.choice(list(SIZES))
    if op in ("move", "drop"):
        return op, None, r.randint(-1, 12), r.randint(-1, 12) if op == "move" else None, None
    return op, ",".join(str(r.randint(-1, 14)) for _ in range(r.randint(1, 7))), None, None, None


def test_random_chains(spark, book):
    r = random.Random(8)
    jobs = {j: [("merge", None, None, None, r.choice(list(SIZES)))] + [random_steps(r) for _ in range(r.randint(0, 12))] for j in range(120)}
    rows = [(j, k, *s) for j, steps in jobs.items() for k, s in enumerate(steps)]
    r.shuffle(rows)
    done = edits.composed(spark.createDataFrame(rows, KIND), book)
    want = sorted((j, k, d, p, f"{d}.{p}") for j, steps in jobs.items() for k, (d, p) in enumerate(plainly(steps), 1))
    assert sorted(map(tuple, edits.edited(book, done).collect())) == want
    assert {x["job_id"]: x["n_pages"] for x in done.collect()} == {j: len(plainly(s)) for j, s in jobs.items()}


def test_failed_steps(spark, book):
    rows = [
        (1, 1, "merge", None, None, None, 1), (1, 2, "extract", "2,x", None, None, None), (1, 3, "remove", "y", None, None, None),
        (2, 1, "merge", None, None, None, 99), (3, 1, "merge", None, None, None, 2), (3, 2, "turn", None, None, None, None),
        (4, 1, "drop", None, 0, None, None), (5, 1, None, None, None, None, None), (6, 1, "merge", None, None, None, 3), (6, 2, "remove_each", None, None, None, None),
    ]
    done = edits.composed(spark.createDataFrame(rows, KIND), book)
    got = {r["job_id"]: (r["success"], r["n_pages"], r["message"]) for r in edits.edit_outcomes(done).collect()}
    assert got[1] == (False, None, 'Failed to extract pages: For input string: "x"')
    assert got[2] == (False, None, "Failed to merge PDFs: no such document")
    assert got[3][:2] == got[5][:2] == (False, None) and got[3][2].endswith("unknown step")
    assert got[4] == (True, 0, "PDFs merged successfully")
    assert got[6] == (False, None, 'Failed to remove pages: For input string: ""')
    assert {r["job_id"]: r["step"] for r in done.collect() if r["step"]} == {1: 2, 2: 1, 3: 2, 5: 1, 6: 2}
    assert edits.edited(book, done).count() == 0


def test_one_join_for_any_number_of_steps(spark, book):
    rows = [(1, 0, "merge", None, None, None, 3)] + [(1, k, "move", None, k % 9, k * 7 % 9, None) for k in range(1, 60)]
    done = edits.composed(spark.createDataFrame(rows, KIND), book)
    out = edits.edited(book, done)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 2  # the documents' sizes, and the pages
    assert [(r["src_doc"], r["src_page"]) for r in out.orderBy("out_page").collect()] == plainly([r[2:] for r in rows])
