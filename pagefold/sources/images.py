"""Sizes of PNG and JPEG images, read from their headers in SQL."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Steps over a JPEG's segments that are tried first. An image whose frame comes later is stepped over byte by byte at most.
STEPS = 32
_FRAME = "^FFC[0-35-79-BD-F]"
#: Markers that stand alone, without a length.
_ALONE = "^FF(01|D[0-8])"


def _hex(content: Column, at: Column | int, n: int) -> Column:
    return F.hex(F.substring(content, at, F.lit(n)) if isinstance(at, Column) else F.substring(content, at, n))


def _number(hexed: Column) -> Column:
    return F.conv(F.nullif(hexed, F.lit("")), 16, 10).try_cast("int")


def size(content: Column) -> Column:
    """struct(width, height) in pixels; null for other bytes. A JPEG's size stands in its first frame header, after any
    number of other segments and of fill bytes; it has none if the picture's data come first."""
    png = F.struct(_number(_hex(content, 17, 4)).alias("width"), _number(_hex(content, 21, 4)).alias("height"))

    def step(at: Column, _: Column) -> Column:
        """The next marker's place: the same at a frame, and where no marker is, or where data or the end begin."""
        head = _hex(content, at, 4)
        return (
            F.when(head.startswith("FFFF"), at + 1).when(head.rlike(_FRAME) | head.rlike("^FFD[9A]") | ~head.startswith("FF"), at).when(head.rlike(_ALONE), at + 2)
            .otherwise(F.when(_number(F.substring(head, 5, 4)) >= 2, at + 2 + _number(F.substring(head, 5, 4))).otherwise(at))
        )

    let = lambda value, body: F.transform(F.array(value), body)[0]
    steps = lambda n, start: F.aggregate(F.sequence(F.lit(1), n), start, step)
    # a step that stays where it is is the last one
    frame = let(steps(F.lit(STEPS), F.lit(3)), lambda at: F.when(step(at, at) == at, at).otherwise(steps(F.octet_length(content), at)))
    whole = lambda at: F.struct(_number(_hex(content, at + 7, 2)).alias("width"), _number(_hex(content, at + 5, 2)).alias("height"))
    jpeg = let(frame, lambda at: F.when(_hex(content, at, 2).rlike(_FRAME) & (F.octet_length(content) >= at + 8), whole(at)))
    start = _hex(content, 1, 8)
    return F.when((start == "89504E470D0A1A0A") & (F.octet_length(content) >= 24), png).when(start.startswith("FFD8"), jpeg)
