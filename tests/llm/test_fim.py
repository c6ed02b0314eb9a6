"""Fill-in-the-middle against plain Python, and the cases its docstring defines."""

import hashlib
import random

import pytest

from pagefold.llm import fim


def plainly(doc_id, text):
    """form, prefix_chars, middle_chars, output."""
    text = text or ""
    n, h = len(text), hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    if not text or any(m in text for m in fim.MARKS) or h3 % 100 >= 90:
        return "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}"


def made(seed=3):
    r = random.Random(seed)
    parts = ["a", "é", "日本", "😀", "\n", "\r\n", " ", "é", "<", "S>", "<P", "M", ">", "\0", " ", "word "]
    rows = [(k, "".join(r.choice(parts) for _ in range(r.choice([0, 1, 2, 30, 63, 64, 65, 127, 128, 129, 400])))) for k in range(600)]
    return [*rows, (None, "a text without id"), (7, None), (8, ""), (9, "<P> in it"), (10, "twice"), (10, "twice"), (11, "<S" * 40), (12, "x" * 3_000_000), (-5, "é" * 200_001)]


def test_forms(spark):
    rows = made()
    docs = spark.createDataFrame([(d, t, "k", 1, "f", 2) for d, t in rows], "doc_id long, text string, form string, n int, output string, row int").repartition(3)
    got = sorted((str(r["doc_id"]), r["n"], r["form"], str(r["prefix_chars"]), str(r["middle_chars"]), r["output"], r["text"]) for r in fim.restored(fim.formed(docs)).collect())
    want = sorted((str(d), len(t or ""), (p := plainly(d, t))[0], str(p[1]), str(p[2]), p[3], t or "") for d, t in rows)
    assert got == want
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_empty_table_and_other_marks(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert fim.restored(fim.formed(none)).count() == 0
    docs = spark.createDataFrame([(k, f"text <P> {k} " * 9) for k in range(40)], "doc_id int, text string")
    marks = ("{p}", "{s}", "{m}")
    back = fim.restored(fim.formed(docs, marks=marks, plain=0, seed="another"), marks).collect()
    assert {r["form"] for r in back} == {"psm", "spm"} and all(r["text"] == f"text <P> {r['doc_id']} " * 9 for r in back)
    with pytest.raises(ValueError):
        fim.formed(docs, marks=("aba", "<S>", "<M>"))
