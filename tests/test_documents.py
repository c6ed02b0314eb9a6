import io
import struct
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from pagefold.functions import markup
from pagefold.operators import overlays, pages
from pagefold.sources import documents, files, images, pdf
from pagefold.streaming import ingest


def png(width=100, height=50, kind=6):
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    rows = b"".join(b"\1" + bytes({2: 3, 6: 4}[kind] * width) for _ in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def jpeg(width=7, height=9):
    return b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x0b\x08" + struct.pack(">HH", height, width) + b"\x01\x01\x11\x00\xff\xd9"


def made_of(pages):
    first, objects = pdf.FIRST + 1, []
    for p in pages:
        objects.append(pdf.page_objects(p, [], first, {}))
        first += len(objects[-1])
    return pdf.assembled(objects, {})


@pytest.fixture
def docs(spark):
    made = [(1, made_of([{"width": 595, "height": 842, "text": f"page {k}\nsecond (line)"} for k in range(1, 6)])), (2, made_of([{"width": 300, "height": 200, "text": ""}])), (3, b"invalid content"), (4, None)]
    return spark.createDataFrame([(d, None if c is None else bytearray(c)) for d, c in made], "doc_id long, content binary")


def test_read_back(docs):
    got = documents.pages(docs).orderBy("doc_id", "page_no").collect()
    assert [(r["doc_id"], r["page_no"], r["text"]) for r in got[:5]] == [(1, k, f"page {k}\nsecond (line)") for k in range(1, 6)]
    assert (got[5]["width"], got[5]["height"], got[5]["text"], got[5]["error"]) == (300.0, 200.0, "", None)
    assert [bool(r["error"]) for r in got] == [False] * 6 + [True, True]


def test_extract_and_paint(spark, docs):
    p = documents.pages(docs).filter("error is null")
    chosen = pages.extract(p, pages.selection(spark, [(1, 3), (2, 1)], "pos int, page_no int")).withColumnRenamed("out_page", "page_no")
    image = spark.createDataFrame([(bytearray(png()),)], "content binary").select("content", images.size(F.col("content")).alias("s")).select("content", "s.width", "s.height")
    drawn = overlays.stamp(chosen, "CONFIDENTIAL").union(overlays.signature(chosen, image, 1, seq=2)).union(overlays.cover(chosen, 100.0, 700.0, 200.0, 30.0, 2, seq=3))
    out = documents.packed(chosen, overlays.painted(drawn), overlays.images(image))
    back = documents.pages(out).filter("doc_id = 1").orderBy("page_no").collect()
    assert [sorted(r["text"].split("\n")) for r in back] == [["CONFIDENTIAL", f"page {k}", "second (line)"] for k in (3, 1)]
    assert b"/I1 Do" in back[0]["payload"] and b"100 700 200 30 re f" in back[1]["payload"]


def test_pages_that_would_lose_something(spark, docs):
    """A page with fonts or images of its own, turned or moved, is read, and fails when it is packed."""
    raw = made_of([{"width": 595, "height": 842, "text": "a /X Do (b"}])
    other = {1: raw.replace(pdf.OWN, b""), 2: raw.replace(b"[0 0 595", b"[5 0 595"), 3: raw.replace(pdf.OWN, b"/Rotate 90 " + pdf.OWN), 4: raw.replace(pdf.OWN, b"/Rotate 0 " + pdf.OWN), 5: raw}
    read = documents.pages(spark.createDataFrame([(k, bytearray(v)) for k, v in other.items()], "doc_id long, content binary"))
    assert [r["text"] for r in read.collect()] == ["a /X Do (b"] * 5
    got = {r["doc_id"]: (r["content"] is not None, r["error"]) for r in documents.packed(read).collect()}
    moved = "the page is turned or its origin is moved"
    assert got == {1: (False, "the page has a resource of its own: /F1"), 2: (False, moved), 3: (False, moved), 4: (True, None), 5: (True, None)}
    p = documents.pages(docs).filter("doc_id = 2")
    image = spark.createDataFrame([(bytearray(png()), 100, 50)], "content binary, width int, height int")
    signed = documents.pages(documents.packed(p, overlays.painted(overlays.signature(p, image)), overlays.images(image)).select("doc_id", "content"))
    assert documents.packed(signed).first()["error"] == "the page has a resource of its own: /I1"
    gif = image.withColumn("content", F.lit("GIF89a").cast("binary"))
    broken = overlays.painted(overlays.signature(p, gif))
    assert documents.packed(p, broken, overlays.images(gif)).first()["error"] == "not a PNG or JPEG image"
    assert documents.packed(p, broken).first()["error"] == documents.packed(p, broken, overlays.images(image)).first()["error"] == "the image is missing"


@pytest.mark.parametrize("before, want", [(b"\xff\xe1\x00\x04ab" * 70, (7, 9)), (b"\xff" * 300, (7, 9)), (b"\xff\xfe\x00\x03a\xff\xff\xff\x01\xff\xd8", (7, 9)), (b"\xff\xda\x00\x02", None), (b"\xff\xe1\x00\x00", None), (b"ab", None), (b"\xff\xe1\xff\xff", None), (b"\xff\xc4\x00\x02\xff\xcc\x00\x02", (7, 9))])
def test_segments_before_a_frame(spark, before, want):
    made = b"\xff\xd8" + before + jpeg()[8:]
    rows = spark.createDataFrame([(bytearray(made),), (bytearray(made[: len(before) + 2]),), (bytearray(b"\xff\xd8"),)], "c binary")
    got = [r["s"] and tuple(r["s"]) for r in rows.coalesce(1).select(images.size(F.col("c")).alias("s")).collect()]
    assert got == [want, None, None]


def test_signatures_of_their_own(spark, docs):
    p = documents.pages(docs).filter("doc_id < 3")
    asked = spark.createDataFrame([(1, 2, None, 7.0, bytearray(png())), (1, 9, 1.0, 1.0, bytearray(png())), (2, None, None, None, bytearray(jpeg())), (2, 1, 1.0, 1.0, bytearray(b"GIF89a"))], "doc_id long, page_no int, x double, y double, content binary")
    drawn = overlays.signatures(p, asked)
    got = sorted((r["doc_id"], r["page_no"], r["x"], r["y"], round(r["w"], 6), round(r["h"], 6)) for r in drawn.collect())
    assert got == [(1, 2, 400.0, 7.0, 30.0, 15.0), (2, 1, 400.0, 100.0, 2.1, 2.7)]
    assert documents.packed(p, overlays.painted(drawn), overlays.images(asked)).filter("error is null").count() == 2
    assert overlays.images(asked).count() == 3


def test_image_sizes(spark):
    got = spark.createDataFrame([(bytearray(x),) for x in (png(), png(3, 2, 2), jpeg(), b"GIF89a")], "c binary").select(images.size(F.col("c")).alias("s")).collect()
    assert [r["s"] and tuple(r["s"]) for r in got] == [(100, 50), (3, 2), (7, 9), None]
    assert b"/DCTDecode" in pdf._image(jpeg()) and b"/Predictor" in pdf._image(png(kind=2))


def test_docx(spark):
    made = spark.createDataFrame([(1, "a & b\n\n<c>\n\n")], "doc_id long, text string").select("doc_id", markup.paragraphs(F.col("text")).alias("paragraphs"))
    content = bytes(documents.docx_files(made).first()["content"])
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        text = z.read("word/document.xml").decode()
    assert text.count("<w:p>") == 2 and "a &amp; b" in text and "&lt;c&gt;" in text


def test_store_and_look_up(spark, tmp_path, docs):
    named = docs.filter("doc_id < 3").select(F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("name"), "content")
    folder = f"file://{tmp_path}/out"
    assert documents.stored(named, folder).count() == 2
    held = files.loaded(spark, folder)
    asked = spark.createDataFrame([("d1.pdf",), ("d9.pdf",), ("../d1.pdf",)], "name string")
    got = {r["name"]: (r["verdict"], r["content"] is not None) for r in files.lookup(asked, held.select("name", "content")).collect()}
    assert got == {"d1.pdf": ("OK", True), "d9.pdf": ("File not found: d9.pdf", False), "../d1.pdf": ("Invalid filename: path separators are not allowed", False)}
    assert files.too_large(spark, folder, most_bytes=800).count() == 1 and files.loaded(spark, folder, most_bytes=800).count() == 1


def test_arriving_files(spark, tmp_path, docs):
    folder = f"file://{tmp_path}/in"
    documents.stored(docs.filter("doc_id = 1").select(F.lit("a.pdf").alias("name"), "content"), folder).collect()
    for _ in range(2):
        ingest.pages_to(spark, folder, f"file://{tmp_path}/pages", f"file://{tmp_path}/state").awaitTermination()
    assert spark.read.parquet(f"file://{tmp_path}/pages").count() == 5


def test_packing_holds_few_documents_at_a_time(spark):
    p = spark.range(700).select(F.when(F.col("id") < 250, -1).otherwise(F.col("id")).alias("doc_id"), (F.col("id") + 1).cast("int").alias("page_no"), F.lit(100.0).alias("width"), F.lit(200.0).alias("height"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"), F.when(F.col("id") == 600, "lost").alias("loss")).coalesce(1)
    out = documents.packed(p)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2 and "ArrowEvalPython" not in plan  # a UDF would hold 10,000 documents
    assert [(r["doc_id"], r["content"], r["error"]) for r in out.filter("error is not null").collect()] == [(600, None, "lost")]
    back = {(r["doc_id"], r["page_no"]): r["text"] for r in documents.pages(out.filter("error is null")).collect()}
    assert back == {(-1, k + 1): f"t{k}" for k in range(250)} | {(k, 1): f"t{k}" for k in range(250, 700) if k != 600}
