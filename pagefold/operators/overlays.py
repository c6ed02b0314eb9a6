"""What is drawn on pages, as rows: doc_id, page_no, seq, kind, x, y, w, h, matrix, text, font, font_size, rgb, image_id.

Operators append rows; nothing is drawn before a sink paints a page's rows in order of seq, so k items cost one join.
An image's bytes are not among them: a sink joins them by image_id where it paints. A cover only hides: the text under it can still be extracted.
"""

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagefold.functions import drawing
from pagefold.operators.pages import INVALID_PAGE, STATED, guarded, page_counts
from pagefold.operators.results import DONE, FAILED
from pagefold.sources import images as image_sizes

SCHEMA = {
    "doc_id": "long", "page_no": "int", "seq": "int", "kind": "string", "x": "double", "y": "double", "w": "double", "h": "double",
    "matrix": "array<double>", "text": "string", "font": "string", "font_size": "double", "rgb": "int", "image_id": "string",
}
MALFORMED_BOXES = "malformed list of boxes"
#: What is said of an opacity beyond 0 to 1, which gives no colour.
BAD_SHADE = "Color parameter outside of expected range: Red Green Blue"
BOXES = "array<struct<x:double,y:double,width:double,height:double,pageNum:double>>"


def _rows(df: DataFrame, **columns: Column) -> DataFrame:
    return df.select(*(columns.get(c, F.col(c) if c in ("doc_id", "page_no") else F.lit(None)).cast(kind).alias(c) for c, kind in SCHEMA.items()))


def _column(value: Column | float) -> Column:
    return value if isinstance(value, Column) else F.lit(float(value))


def stamp(pages: DataFrame, text: Column | str, x: float | None = None, y: float | None = None, rotation: float = 45.0, opacity: Column | float = 0.3, seq: int = 1) -> DataFrame:
    """A text across all pages (doc_id, page_no, width, height): cut to 30 characters, from the middle of the page unless x
    and y are given, in a gray that stands for the opacity. Pages whose opacity gives no colour get none; see stamp_status()."""
    shade = drawing.gray(_column(opacity))
    pages = pages.filter(shade.isNotNull())
    at = [F.coalesce(F.lit(v).cast("double"), F.col(side) / 2) for v, side in ((x, "width"), (y, "height"))]
    return _rows(
        pages, seq=F.lit(seq), kind=F.lit("stamp"), x=at[0], y=at[1], matrix=drawing.turned(F.lit(float(rotation)), *at), font=F.lit("HELVETICA_BOLD"),
        text=F.substring(F.lit(text) if isinstance(text, str) else text, 1, drawing.STAMP_CHARACTERS), font_size=F.lit(drawing.STAMP_SIZE), rgb=shade * 65793,
    )


def stamp_cause(text: Column, opacity: Column) -> Column:
    """Why a stamp can't be painted: an opacity without a colour, or a character that its font lacks; null if it can."""
    return F.when(drawing.gray(opacity).isNull(), F.lit(BAD_SHADE)).otherwise(drawing.lacking(F.substring(text, 1, drawing.STAMP_CHARACTERS), F.lit("HELVETICA_BOLD")))


def stamp_status(docs: DataFrame, opacity: Column | float = 0.3, text: Column | str = "") -> DataFrame:
    """Of each row of docs whether its stamp can be painted: doc_id, success, message."""
    cause = stamp_cause(F.lit(text) if isinstance(text, str) else text, _column(opacity))
    return docs.select("doc_id", cause.isNull().alias("success"), F.when(cause.isNull(), F.lit(DONE["stamp"])).otherwise(F.concat(F.lit(f"{FAILED['stamp']}: "), cause)).alias("message"))


def texts(pages: DataFrame, items: DataFrame) -> DataFrame:
    """items: doc_id, page_no, seq, text, x, y, font_size, font, colour; null x, y and font_size are 50, 750 and 12. Items on
    pages that a document lacks are left out; see checked()."""
    default = lambda c, v: F.coalesce(F.col(c), F.lit(v))
    joined = items.join(pages.select("doc_id", "page_no"), ["doc_id", "page_no"])
    return _rows(joined, seq=F.col("seq"), kind=F.lit("text"), x=default("x", 50.0), y=default("y", 750.0), text=F.col("text"), font=drawing.font(F.col("font")), font_size=default("font_size", 12.0), rgb=drawing.rgb(F.col("colour")))


def images(content: DataFrame) -> DataFrame:
    """content: content (bytes). Each different image once: image_id (its SHA-256) and content, for a sink to join."""
    return content.filter("content is not null").select(F.sha2("content", 256).alias("image_id"), "content").dropDuplicates(["image_id"])


def signature(pages: DataFrame, image: DataFrame, page_no: int = 1, x: float = 400.0, y: float = 100.0, seq: int = 1) -> DataFrame:
    """image: one row of content, width and height in pixels, drawn at 0.3 of its size. The rows name it by its id; see
    images(). Documents without the page get none; see signature_status()."""
    found = image.select(F.sha2("content", 256).alias("image_id"), "width", "height").limit(2).collect()
    if len(found) != 1:
        raise ValueError("one image is wanted")
    size = [F.lit(side * drawing.SIGNATURE_SCALE if side is not None else None) for side in (found[0]["width"], found[0]["height"])]
    return _rows(pages.filter(F.col("page_no") == page_no), seq=F.lit(seq), kind=F.lit("image"), x=F.lit(x), y=F.lit(y), w=size[0], h=size[1], image_id=F.lit(found[0]["image_id"]))


def signatures(pages: DataFrame, requests: DataFrame, seq: int = 1) -> DataFrame:
    """requests: doc_id, page_no, x, y, content; null page_no, x and y are 1, 400 and 100. As signature(), with an image of its own for each request;
    requests for pages that a document lacks, and those whose image has no size, give no rows."""
    size = image_sizes.size(F.col("content"))
    named = requests.select("doc_id", F.coalesce("page_no", F.lit(1)).alias("page_no"), F.coalesce("x", F.lit(400.0)).alias("x"), F.coalesce("y", F.lit(100.0)).alias("y"), F.sha2("content", 256).alias("image_id"), size.alias("size")).filter("size is not null")
    joined = named.join(pages.select("doc_id", "page_no"), ["doc_id", "page_no"])
    return _rows(joined, seq=F.lit(seq), kind=F.lit("image"), x=F.col("x"), y=F.col("y"), w=F.col("size.width") * drawing.SIGNATURE_SCALE, h=F.col("size.height") * drawing.SIGNATURE_SCALE, image_id=F.col("image_id"))


def cover(pages: DataFrame, x: float, y: float, w: float, h: float, page_no: int = 1, seq: int = 1) -> DataFrame:
    """A black box. Documents without the page get none; see cover_status()."""
    return _rows(pages.filter(F.col("page_no") == page_no), seq=F.lit(seq), kind=F.lit("rect"), x=F.lit(x), y=F.lit(y), w=F.lit(w), h=F.lit(h), rgb=F.lit(0))


def boxes(text: Column) -> Column:
    """The boxes of a JSON array, or null if it is none or any box lacks a number; other keys are not looked at. Numbers in
    quotes, and what is no number in JSON (NaN, Infinity), are none."""
    parsed = F.from_json(text, BOXES, {"allowNonNumericNumbers": "false"})
    lacks = lambda b: F.coalesce(b.x, b.y, b.width, b.height, b.pageNum).isNull() | b.x.isNull() | b.y.isNull() | b.width.isNull() | b.height.isNull() | b.pageNum.isNull()
    return F.when(text.rlike(r"^[ \t\r\n]*\[") & ~F.exists(parsed, lacks), parsed)


def cover_many(pages: DataFrame, requests: DataFrame) -> DataFrame:
    """requests: doc_id, json. A row for each box on a page that the document has, seq in the order of the array; the
    page number is cut to an integer, and one beyond integers is on no page. Requests that boxes() finds malformed give no rows; see checked_boxes()."""
    drawn = requests.select("doc_id", F.posexplode(boxes(F.col("json"))).alias("k", "b")).select("doc_id", (F.col("k") + 1).alias("seq"), F.greatest(F.lit(-1.0), F.least(F.lit(2147483647.0), F.col("b.pageNum"))).cast("int").alias("page_no"), "b")
    joined = drawn.join(pages.select("doc_id", "page_no"), ["doc_id", "page_no"])
    return _rows(joined, seq=F.col("seq"), kind=F.lit("rect"), x=F.col("b.x"), y=F.col("b.y"), w=F.col("b.width"), h=F.col("b.height"), rgb=F.lit(0))


def checked_boxes(requests: DataFrame) -> DataFrame:
    """doc_id, success, message."""
    ok = boxes(F.col("json")).isNotNull()
    return requests.select("doc_id", ok.alias("success"), F.when(ok, F.lit(DONE["cover"])).otherwise(F.lit(f"{FAILED['cover']}: {MALFORMED_BOXES}")).alias("message"))


def signature_status(pages: DataFrame, page_no: int = 1) -> DataFrame:
    """Of each document whether signature() finds its page: doc_id, page_no, message, success."""
    return guarded(pages, page_no, DONE["signature"], FAILED["signature"])


def cover_status(pages: DataFrame, page_no: int = 1) -> DataFrame:
    """The same of cover()."""
    return guarded(pages, page_no, DONE["cover"], FAILED["cover"])


def checked(pages: DataFrame, items: DataFrame, done: str, failed: str) -> DataFrame:
    """doc_id, success, message of each document with items: it fails if any names a page that it lacks."""
    held = items.groupBy("doc_id").agg(F.min("page_no").alias("least"), F.max("page_no").alias("most")).join(page_counts(pages), "doc_id", "left")
    ok = F.coalesce((F.col("least") >= 1) & (F.col("most") <= F.col("page_count")), F.lit(False))
    return held.select("doc_id", ok.alias("success"), F.when(ok, F.lit(done)).otherwise(F.lit(f"{failed}: {INVALID_PAGE}")).alias("message"))


def checked_texts(pages: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, success, message of each document with items (doc_id, page_no, seq, text, font): what is wrong with the first,
    in order of seq, that can't be drawn, as its page is missing or its font lacks a character."""
    counted = items.join(page_counts(pages).select("doc_id", "page_count"), "doc_id", "left")
    there = F.coalesce(F.col("page_no").between(F.lit(1), F.col("page_count")), F.lit(False))
    cause = F.when(~there, F.lit(INVALID_PAGE)).otherwise(drawing.lacking(F.col("text"), drawing.font(F.col("font"))))
    first = counted.withColumn("cause", cause).groupBy("doc_id").agg(F.min_by("cause", F.when(F.col("cause").isNotNull(), F.struct("seq", "cause"))).alias("cause"))
    ok = F.col("cause").isNull()
    return first.select("doc_id", ok.alias("success"), F.when(ok, F.lit(DONE["text"])).otherwise(F.concat(F.lit(f"{FAILED['text']}: "), "cause")).alias("message"))


ITEM = {"page_no": "int", "text": "string", "x": "double", "y": "double", "font_size": "double", "font": "string", "colour": "string"}


def stated_texts(docs: DataFrame, items: Sequence[tuple]) -> DataFrame:
    """The same items (page_no, text, x, y, font_size, font, colour) for each doc_id of docs, in their order. The items are a
    literal that each row unfolds, so nothing is joined."""
    if len(items) > STATED:
        raise ValueError(f"{STATED} stated items at most")
    held = F.from_json(F.lit(json.dumps([dict(zip(ITEM, i, strict=True)) for i in items])), f"array<struct<{','.join(f'{c}:{kind}' for c, kind in ITEM.items())}>>")
    each = docs.select("doc_id").distinct().select("doc_id", F.posexplode(held).alias("k", "i"))
    return each.select("doc_id", (F.col("k") + 1).alias("seq"), "i.*")


def painted(overlays: DataFrame) -> DataFrame:
    """Overlays with seq counted anew over all kinds on a page, in order of seq and kind."""
    return overlays.withColumn("seq", F.row_number().over(Window.partitionBy("doc_id", "page_no").orderBy("seq", "kind")))
