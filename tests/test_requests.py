"""Requests of every route: what a form may send, one row of results for each."""

import pytest

from pagefold.operators import overlays, requests, results
from pagefold.sources import documents
from pyspark.sql import functions as F

KIND = "job_id long, operation string, doc_ids array<bigint>, name string, params map<string,string>, image binary"
PNG = bytes.fromhex("89504E470D0A1A0A0000000D4948445200000064000000320806000000")
BOX = {"x": "1", "y": "2", "width": "3", "height": "4"}
FINE = "[]"

#: operation, files, params, image; status and message, and how many outputs.
CASES = [
    ("merge", [1, 2], None, None, 200, results.DONE["merge"], 1), ("merge", [1, 9], {}, None, 400, "Failed to merge PDFs: no such document", 0), ("merge", [1, 3], {}, None, 400, "Failed to merge PDFs: broken", 0),
    ("merge", [1, 2, 1], {}, None, 413, results.TOO_LARGE, 0), ("merge", [2, 2], {}, None, 200, results.DONE["merge"], 1), ("merge", [], {}, None, 500, results.UNEXPECTED, 0),
    ("split", [1], {}, None, 200, "PDF split into 5 documents", 5), ("split", [1], {"groups": " "}, None, 200, "PDF split into 5 documents", 5), ("split", [1], {"groups": "1-2;9;3"}, None, 200, "PDF split into 2 documents", 2),
    ("split", [1], {"groups": "1;-3"}, None, 400, 'Failed to split PDF: For input string: ""', 0), ("split", [1], {"groups": "3-;x"}, None, 400, "Failed to split PDF: Index 1 out of bounds for length 1", 0),
    ("split", [1], {"groups": "-"}, None, 400, "Failed to split PDF: Index 0 out of bounds for length 0", 0), ("split", [1], {"groups": "2,b-1"}, None, 400, 'Failed to split PDF: For input string: "b"', 0), ("split", [2], {"groups": ";"}, None, 200, "PDF split into 0 documents", 0),
    ("extract", [1], {"pages": "3, 1"}, None, 200, results.DONE["extract"], 1), ("extract", [1], {}, None, 400, "Missing required parameter: pages", 0), ("extract", [1], {"pages": "5-7"}, None, 400, 'Invalid input: For input string: "5-7"', 0),
    ("extract", [3], {"pages": "x"}, None, 400, 'Invalid input: For input string: "x"', 0), ("remove", [1], {"pages": ""}, None, 400, 'Invalid input: For input string: ""', 0), ("remove", [1], {"pages": "99999999999"}, None, 400, 'Invalid input: For input string: "99999999999"', 0),
    ("watermark", [1], {"text": "ok", "opacity": "0"}, None, 200, results.DONE["stamp"], 1), ("watermark", [1], {"text": "ok", "opacity": "-0.5"}, None, 400, f"Failed to add watermark: {overlays.BAD_SHADE}", 0),
    ("watermark", [5], {"text": "ok", "opacity": "7"}, None, 200, results.DONE["stamp"], 1), ("watermark", [1], {"text": "x" * 30 + "中"}, None, 200, results.DONE["stamp"], 1), ("watermark", [1], {"text": "x", "x": "1e"}, None, 500, results.UNEXPECTED, 0),
    ("add-text", [2], {"text": "t", "page": "2"}, None, 400, "Failed to add text: Invalid page number", 0), ("add-text", [2], {"text": "t", "page": " 1 ", "fontSize": " "}, None, 200, results.DONE["text"], 1),
    ("add-text", [2], {"text": "日", "page": "1"}, None, 400, "Failed to add text: U+65E5 is not available in the font HELVETICA", 0), ("add-text", [2], {"text": "t", "page": "1.5"}, None, 500, results.UNEXPECTED, 0),
    ("add-signature", [1], {}, None, 500, results.UNEXPECTED, 0), ("add-signature", [1], {"page": "5"}, PNG, 200, results.DONE["signature"], 1), ("add-signature", [1], {"page": "6"}, b"x", 400, "Failed to add signature: Invalid page number", 0),
    ("add-signature", [1], {}, b"x", 400, "Failed to add signature: not a PNG or JPEG image", 0), ("redact", [1], BOX, None, 200, results.DONE["cover"], 1), ("redact", [1], BOX | {"width": " "}, None, 400, "Missing required parameter: width", 0),
    ("redact", [1], {"height": "4"}, None, 400, "Missing required parameter: x", 0), ("redact", [1], BOX | {"page": "0"}, None, 400, "Failed to redact content: Invalid page number", 0),
    ("redact-multiple", [1], {"redactions": FINE}, None, 200, results.DONE["cover"], 1), ("redact-multiple", [1], {"redactions": "{}"}, None, 400, f"Failed to redact content: {overlays.MALFORMED_BOXES}", 0), ("redact-multiple", [1], None, None, 400, "Missing required parameter: redactions", 0),
    ("convert/markdown", [1], {}, None, 200, results.DONE["markdown"], 1), ("convert/docx", [3], {}, None, 400, "Failed to convert to DOCX: broken", 0), ("info", [1], {}, None, 200, "Pages: 5", 0), ("info", [5], {}, None, 200, "Pages: 0", 0),
    ("download", None, {"filename": "have.pdf"}, None, 200, "OK", 1), ("download", None, {"filename": "lack.pdf"}, None, 400, "File not found: lack.pdf", 0), ("download", [], {}, None, 400, "Filename cannot be null or empty", 0),
    ("remove", [1], {"pages": "2,2"}, None, 200, results.DONE["remove"], 1), ("convert/markdown", [9], {}, None, 400, "Failed to convert to Markdown: no such document", 0), ("convert/docx", [2], {}, None, 200, results.DONE["docx"], 1),
    ("info", [3], {}, None, 400, "Failed to get PDF info: broken", 0), ("health-check", [1], {}, None, 500, results.UNEXPECTED, 0), (None, [1], {}, None, 500, results.UNEXPECTED, 0), ("extract", None, {"pages": "1"}, None, 500, results.UNEXPECTED, 0),
]


@pytest.fixture
def answers(spark):
    known = spark.createDataFrame([(1, 5, 40, None), (2, 1, 50, None), (3, None, 10, "broken"), (4, 2, 61, None), (5, 0, 1, None)], "doc_id long, page_count long, length long, error string")
    stored = spark.createDataFrame([("have.pdf",), ("have.pdf",), (None,)], "name string")
    rows = [(k, op, files, "in/plan.PDF", params, None if image is None else bytearray(image)) for k, (op, files, params, image, *_) in enumerate(CASES)]
    return {r["job_id"]: r for r in requests.answered(spark.createDataFrame(rows, KIND), known, stored, most_bytes=100).collect()}


def test_every_case(answers):
    assert len(answers) == len(CASES)
    for k, (op, _, _, _, status, message, n) in enumerate(CASES):
        assert (answers[k]["status"], answers[k]["message"], len(answers[k]["outputs"])) == (status, message, n), (k, op)
        assert answers[k]["success"] == (status == 200)


def test_columns_that_lack_or_clash(spark):
    known = spark.createDataFrame([(1, 5, 40, None, "x")], "doc_id long, page_count long, length long, error string, kind string")
    asked = spark.createDataFrame([(1, "info", [1], 7, "a", 1), (2, "merge", [1], 7, "b", 2)], "job_id long, operation string, doc_ids array<bigint>, doc_id long, kind string, n_files int")
    got = {r["job_id"]: (r["status"], r["message"], r["doc_id"], [x[:7] for x in r["outputs"]]) for r in requests.answered(asked, known, spark.createDataFrame([], "name string")).collect()}
    assert got == {1: (200, "Pages: 5", 1, []), 2: (200, results.DONE["merge"], 1, ["merged_"])}


def test_every_route_fails_and_succeeds(answers):
    by_route = {}
    for k, (op, *_) in enumerate(CASES):
        by_route.setdefault(op, set()).add(answers[k]["success"])
    assert all(by_route[route] == {True, False} for route in requests.ROUTES)


def test_names_of_outputs(answers):
    names = {op: answers[k]["outputs"] for k, (op, *_) in enumerate(CASES) if answers[k]["outputs"]}
    assert names["convert/markdown"][0].startswith("plan_markdown_") and names["convert/markdown"][0].endswith(".md")
    whole = answers[8]["outputs"]
    assert [x[:18] for x in whole] == ["plan_split_part1_" + whole[0][17], "plan_split_part3_" + whole[1][17]]
    assert [x[:17] for x in answers[6]["outputs"]] == [f"plan_split_page{k}_" for k in range(1, 6)]


def test_raised_text_stays_in_its_line(spark):
    shown = [(100.0, 50.0, "H"), (102.0, 58.0, "2"), (100.5, 66.0, "O"), (114.0, 50.0, "next"), (104.0, 90.0, "x"), (118.5, 10.0, "own")]
    rows = spark.createDataFrame([(1, shown), (2, []), (3, None)], "k int, s array<struct<y:double,x:double,text:string>>")
    got = {r["k"]: r["t"] for r in rows.select("k", documents.lines(F.col("s")).alias("t")).collect()}
    assert got == {1: "H 2 O x\nnext\nown", 2: "", 3: None}


def test_texts_that_a_font_lacks(spark):
    items = spark.createDataFrame([(1, 1, 1, "fine", None), (1, 9, 2, "late", None), (2, 1, 1, "ā", None), (2, 9, 2, "x", None), (3, 1, 1, "€", "courier"), (4, 1, 1, "x", None)], "doc_id long, page_no int, seq int, text string, font string")
    p = spark.createDataFrame([(d, 1, 595.0, 842.0, "") for d in (1, 2, 3)], "doc_id long, page_no int, width double, height double, text string")
    got = {r["doc_id"]: r["message"] for r in overlays.checked_texts(p, items).collect()}
    assert got == {1: "Failed to add text: Invalid page number", 2: "Failed to add text: U+0101 is not available in the font HELVETICA", 3: results.DONE["text"], 4: "Failed to add text: Invalid page number"}
    drawn = overlays.texts(p, items.withColumns({"x": F.lit(1.0), "y": F.lit(1.0), "font_size": F.lit(9.0), "colour": F.lit("0")}))
    errors = {r["doc_id"]: r["error"] for r in documents.packed(p, overlays.painted(drawn)).collect()}
    assert errors == {1: None, 2: "U+0101 is not available in the font HELVETICA", 3: None}


def test_stamps_without_a_colour_are_not_painted(spark):
    p = spark.createDataFrame([(d, 1, 595.0, 842.0, d / 2 - 1) for d in range(7)], "doc_id long, page_no int, width double, height double, o double")
    assert sorted(r["doc_id"] for r in overlays.stamp(p, "x", opacity=F.col("o")).collect()) == [2, 3, 4]
    assert sorted(r["doc_id"] for r in overlays.stamp_status(p, F.col("o"), "x").filter("success").collect()) == [2, 3, 4]
