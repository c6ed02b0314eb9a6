import pytest
from pyspark.sql import functions as F

from pagefold.functions import drawing, markup, names
from pagefold.operators import overlays, results


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("name, want", [(None, "x"), ("", "x"), ("a.PDF", "a_x"), (".pdf", "x"), ("///", "x"), ("..\\x.pdf", "x_x"), ("a.pdf.pdf", "a.pdf_x"), ("a\0b.pdf", "ab_x"), ("../up/./plan.pdf", "plan_x")])
def test_base_name(spark, name, want):
    assert value(spark, names.base_name(F.lit(name).cast("string"), "x")) == want


@pytest.mark.parametrize("name", ["q.pdf", "Minutes of May.pdf", "plan..b7.pdf", "{draft} #3.pdf", "a-b_c9.pdf", "notes.md", "Letter.DOCX"])
def test_good_names(spark, name):
    assert value(spark, names.verdict(F.lit(name))) == "OK"


@pytest.mark.parametrize(
    "name, want",
    [("../up/list", names.SEPARATOR), ("..\\up\\list", names.SEPARATOR), ("/list.pdf", names.SEPARATOR), ("D:\\list.md", names.SEPARATOR), ("a\0.pdf", names.NUL), (None, names.EMPTY), ("", names.EMPTY), (" \t ", names.EMPTY), ("in/plan.pdf", names.SEPARATOR), ("plan.odt", names.EXTENSION), ("...pdf", names.PARENT), (".pdf", names.MALFORMED), ("x.", names.MALFORMED)],
)
def test_bad_names(spark, name, want):
    assert value(spark, names.verdict(F.lit(name).cast("string"))) == want


@pytest.mark.parametrize("name, want", [("helvetica-bold", "HELVETICA_BOLD"), ("nonesuch", "HELVETICA"), (None, "HELVETICA"), ("Zapf_Dingbats", "ZAPF_DINGBATS")])
def test_font(spark, name, want):
    assert value(spark, drawing.font(F.lit(name).cast("string"))) == want


@pytest.mark.parametrize("text, want", [("#FF0000", 0xFF0000), ("#fff", 0xFFF), ("0x10", 16), ("010", 8), ("255", 255), ("red", 0), (None, 0), ("", 0), ("#", 0), ("-1", 0xFFFFFF), ("99999999999", 0)])
def test_rgb(spark, text, want):
    assert value(spark, drawing.rgb(F.lit(text).cast("string"))) == want


def test_gray(spark):
    assert [value(spark, drawing.gray(F.lit(x))) for x in (0.3, 0.0, 1.0, 2.0, 0.6, 0.1)] == [178, 255, 0, None, 101, 229]


@pytest.mark.parametrize(
    "text, md, paras",
    [(None, markup.HEADING + markup.NO_TEXT, [markup.NO_TEXT]), (" \t\n", markup.HEADING + markup.NO_TEXT, [markup.NO_TEXT]), ("a\n\nb\n\n", markup.HEADING + "a\n\n\nb\n\n", ["a", "b"]), ("a\n\t\nb", markup.HEADING + "a\n\n\nb\n\n", ["a\n\t\nb"])],
)
def test_markup(spark, text, md, paras):
    t = F.lit(text).cast("string")
    assert value(spark, markup.markdown(t)) == md
    assert value(spark, markup.paragraphs(t)) == paras


@pytest.mark.parametrize("json, want", [("[]", 0), ("nope", None), ("[1,2]", None), ('{"x":1,"y":1,"width":1,"height":1,"pageNum":1}', None), ('[{"x":1,"y":1,"width":1,"height":1}]', None), ('[{"x":"2","y":1,"width":1,"height":1,"pageNum":1}]', None), ('[{"x":1,"y":1,"width":1,"height":1,"pageNum":1.9,"z":0}]', 1), ('\n\t [{"x":1,"y":1,"width":1,"height":1,"pageNum":1}]', 1), ('[{"x":"NaN","y":1,"width":1,"height":1,"pageNum":1}]', None), ('[{"x":NaN,"y":1,"width":1,"height":1,"pageNum":1}]', None), ('[{"x":1,"y":"Infinity","width":1,"height":1,"pageNum":1}]', None), ('[{"x":1,"y":-Infinity,"width":1,"height":1,"pageNum":1}]', None), ("[null]", None)])
def test_boxes(spark, json, want):
    got = value(spark, overlays.boxes(F.lit(json)))
    assert (None if got is None else len(got)) == want


def test_strict_results_fail(spark):
    rows = spark.createDataFrame([(1, 1)], "job_id int, doc_id int")
    soft = results.results(rows, "cover", F.lit(False), F.lit("why"), F.array(F.lit("a"))).first()
    assert (soft["success"], soft["message"], soft["outputs"]) == (False, "Failed to redact content: why", [])
    with pytest.raises(Exception, match="why"):
        results.results(rows, "cover", F.lit(False), F.lit("why"), F.array(F.lit("a")), strict=True).collect()
