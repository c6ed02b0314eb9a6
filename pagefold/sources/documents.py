"""Binary documents to page tables and back. Contents never move in a shuffle but where a document's pages are packed."""

import io
import os
import re
import uuid
import zipfile
from xml.sax.saxutils import escape, unescape

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagefold.functions import drawing
from pagefold.sources import pdf
from pagefold.sources.batches import gathered, pieces

PAGES = "doc_id long, page_no int, width double, height double, text string, payload binary, error string, loss string"
_READ = PAGES.replace("text string", "shown array<struct<y:double,x:double,text:string>>")


#: Points by which the text of a line may be raised or lowered.
RISE = 4.0


def lines(shown: Column, rise: float = RISE) -> Column:
    """The text of what a page shows (y, x, text): lines from top to bottom, the parts of each from left to right. A line
    begins with what stands highest and holds all that is lower by rise at most, so that raised text stays in it."""
    held = "array<struct<line:int,x:double,y:double,text:string>>"
    begin = F.struct(F.lit(0).alias("line"), F.lit(None).cast("double").alias("top"), F.array().cast(held).alias("out"))

    def deal(a: Column, s: Column) -> Column:
        new = F.coalesce(s["y"] - a["top"] > rise, F.lit(True))
        line, top = a["line"] + new.cast("int"), F.when(new, s["y"]).otherwise(a["top"])
        part = F.struct(line.alias("line"), s["x"].alias("x"), s["y"].alias("y"), s["text"].alias("text"))
        return F.struct(line.alias("line"), top.alias("top"), F.concat(a["out"], F.array(part)).alias("out"))

    start = F.struct(F.lit(None).cast("int").alias("line"), F.lit(None).cast("string").alias("text"))
    add = lambda a, s: F.struct(s["line"].alias("line"), F.when(a["text"].isNull(), s["text"]).otherwise(F.concat(a["text"], F.when(a["line"] == s["line"], F.lit(" ")).otherwise(F.lit("\n")), s["text"])).alias("text"))
    dealt = F.array_sort(F.aggregate(F.array_sort(shown), begin, deal)["out"])
    return F.when(shown.isNotNull(), F.coalesce(F.aggregate(dealt, start, add)["text"], F.lit("")))


def pages(documents: DataFrame) -> DataFrame:
    """documents: doc_id, content. A row for each page; a document that can't be read is one row with error alone. loss says
    why packed() would lose something of a page, null if it would not."""
    shown = pa.list_(pa.struct([("y", pa.float64()), ("x", pa.float64()), ("text", pa.string())]))
    schema = pa.schema([("doc_id", pa.int64()), ("page_no", pa.int32()), ("width", pa.float64()), ("height", pa.float64()), ("shown", shown), ("payload", pa.binary()), ("error", pa.string()), ("loss", pa.string())])

    def run(batches):
        for b in batches:
            for doc_id, content in zip(b.column("doc_id").to_pylist(), b.column("content"), strict=True):
                try:
                    rows = [{"doc_id": doc_id, **p} for p in pdf.read(content.as_py() or b"")]
                except Exception as e:  # of any malformed file
                    rows = [{"doc_id": doc_id, "error": str(e) or type(e).__name__}]
                yield pa.RecordBatch.from_pylist(rows, schema)

    read = documents.select("doc_id", "content").mapInArrow(run, _READ)
    return read.select("doc_id", "page_no", "width", "height", lines(F.col("shown")).alias("text"), "payload", "error", "loss")


def document_texts(page_rows: DataFrame) -> DataFrame:
    """doc_id and text: the texts of a document's pages in order, one after another."""
    held = F.transform(F.array_sort(F.collect_list(F.struct("page_no", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"])
    return page_rows.groupBy("doc_id").agg(F.array_join(held, "\n").alias("text"))


def packed(page_rows: DataFrame, overlays: DataFrame | None = None, images: DataFrame | None = None) -> DataFrame:
    """page_rows: doc_id, page_no, width, height, payload or text, and loss as pages() gives it, if any. One file for each
    document, its pages in order of page_no with their overlays painted in order of seq: doc_id, content, error. Where a page
    would lose something, content is null and error says why. images: image_id, content of those that overlays name; their
    bytes move to the pages that show them, once. Pages are encoded each by itself, under object numbers from a
    running count; for a document, only its ready objects are put together."""
    held = {c: F.col(c) if c in page_rows.columns else F.lit(None).cast(kind) for c, kind in (("payload", "binary"), ("text", "string"), ("loss", "string"))}
    rows = page_rows.select("doc_id", "page_no", F.col("width").cast("double").alias("width"), F.col("height").cast("double").alias("height"), *(v.alias(c) for c, v in held.items()))
    if overlays is None:
        rows = rows.withColumn("drawn", F.array())
        n_images = F.lit(0)
    else:
        painted = F.struct(*(c for c in overlays.columns if c not in ("doc_id", "page_no")))
        by_page = overlays.groupBy("doc_id", "page_no").agg(F.array_sort(F.collect_list(painted)).alias("drawn"))
        rows = rows.join(by_page, ["doc_id", "page_no"], "left")
        n_images = F.coalesce(F.size(F.filter("drawn", lambda o: o.kind == "image")), F.lit(0))
    shown = F.lit(None).cast("map<string,binary>")
    if overlays is not None and images is not None:
        named = overlays.filter("kind = 'image'").select("doc_id", "page_no", "image_id").distinct().join(images.select("image_id", "content"), "image_id")
        rows = rows.join(named.groupBy("doc_id", "page_no").agg(F.map_from_entries(F.collect_list(F.struct("image_id", "content"))).alias("shown")), ["doc_id", "page_no"], "left")
        shown = F.col("shown")
    before = Window.partitionBy("doc_id").orderBy("page_no").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("shown", shown).withColumn("first", F.coalesce(F.sum(n_images + 2).over(before), F.lit(0)) + (pdf.FIRST + len(drawing.FONTS) + 1))
    kind = pa.schema([("doc_id", pa.int64()), ("first", pa.int64()), ("objects", pa.list_(pa.binary())), ("error", pa.string())])

    def encode(batches):
        def pages():
            for b in pieces(batches):
                for p in b.to_pylist():
                    objects, error = [], p["loss"]
                    found = dict(p["shown"] or [])
                    try:
                        drawn = [o | {"image": found.get(o["image_id"])} if o["kind"] == "image" else o for o in p["drawn"] or []]
                        objects = pdf.page_objects(p, drawn, p["first"], drawing.FONTS) if error is None else []
                    except ValueError as e:  # an image or a text that can't be drawn
                        error = str(e)
                    yield {"doc_id": p["doc_id"], "first": p["first"], "objects": objects, "error": error}, sum(map(len, objects))

        return gathered(pages(), kind)

    def assemble(batches):
        def files():
            for b in pieces(batches):
                for doc_id, own, error in zip(b.column("doc_id").to_pylist(), b.column("own"), b.column("error").to_pylist(), strict=True):
                    content = pdf.assembled(own.as_py(), drawing.FONTS) if error is None else None
                    yield {"doc_id": doc_id, "content": content, "error": error}, len(content or b"")

        return gathered(files(), pa.schema([("doc_id", pa.int64()), ("content", pa.binary()), ("error", pa.string())]))

    encoded = rows.mapInArrow(encode, "doc_id long, first long, objects array<binary>, error string")
    whole = encoded.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("first", "objects"))).alias("own"), F.min("error").alias("error"))
    ready = F.when(F.col("error").isNull(), F.transform("own", lambda x: x["objects"]))
    return whole.select("doc_id", ready.alias("own"), "error").mapInArrow(assemble, "doc_id long, content binary, error string")


# The parts of a minimal word-processing package.
_TYPES = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'
_RELATIONS = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'
_DOCUMENT = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{}</w:body></w:document>'


def docx(paragraphs: list[str]) -> bytes:
    """A word-processing file of these paragraphs; characters that XML lacks are left out."""
    clean = ("".join(c for c in p if c in "\t\n\r" or c >= " " and c not in "\ufffe\uffff") for p in paragraphs)
    body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(p)}</w:t></w:r></w:p>' for p in clean)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in (("[Content_Types].xml", _TYPES), ("_rels/.rels", _RELATIONS), ("word/document.xml", _DOCUMENT.format(body))):
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), text, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def docx_files(texts: DataFrame) -> DataFrame:
    """texts: doc_id, paragraphs (see markup.paragraphs). doc_id, content."""

    @F.pandas_udf("binary")
    def content(paragraphs: pd.Series) -> pd.Series:
        return paragraphs.map(lambda p: docx(list(p)) if p is not None else None)

    return texts.select("doc_id", content("paragraphs").alias("content"))


def docx_paragraphs(files: DataFrame) -> DataFrame:
    """files: doc_id, content, as docx_files() makes them. doc_id, paragraphs."""

    @F.pandas_udf("array<string>")
    def paragraphs(content: pd.Series) -> pd.Series:
        def read(raw):
            with zipfile.ZipFile(io.BytesIO(raw)) as z:
                return [unescape(x) for x in re.findall(r"<w:t[^>]*>(.*?)</w:t>", z.read("word/document.xml").decode(), re.S)]

        return content.map(lambda raw: read(raw) if raw is not None else None)

    return files.select("doc_id", paragraphs("content").alias("paragraphs"))


def stored(files: DataFrame, folder: str) -> DataFrame:
    """files: name, content. Writes each under folder (a URI that executors can write to) by another name first, so that a
    task that is run again or lost leaves whole files only. Returns name, n_bytes of what was written."""

    def run(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        for b in batches:
            for name, content in zip(b.column("name").to_pylist(), b.column("content"), strict=True):
                content = content.as_py()
                if os.path.basename(name) != name:
                    raise ValueError(f"not a file name: {name}")
                with store.open_output_stream(draft := f"{root}/_{uuid.uuid4().hex}") as f:
                    f.write(content)
                store.move(draft, f"{root}/{name}")
                yield pa.RecordBatch.from_pydict({"name": [name], "n_bytes": [len(content)]})

    return files.select("name", "content").mapInArrow(run, "name string, n_bytes long")
