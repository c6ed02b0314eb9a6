"""Places, fonts and colours of what is drawn on pages."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 14 standard fonts by their enumeration names.
FONTS = {
    "TIMES_ROMAN": "Times-Roman", "TIMES_BOLD": "Times-Bold", "TIMES_ITALIC": "Times-Italic", "TIMES_BOLD_ITALIC": "Times-BoldItalic",
    "HELVETICA": "Helvetica", "HELVETICA_BOLD": "Helvetica-Bold", "HELVETICA_OBLIQUE": "Helvetica-Oblique", "HELVETICA_BOLD_OBLIQUE": "Helvetica-BoldOblique",
    "COURIER": "Courier", "COURIER_BOLD": "Courier-Bold", "COURIER_OBLIQUE": "Courier-Oblique", "COURIER_BOLD_OBLIQUE": "Courier-BoldOblique",
    "SYMBOL": "Symbol", "ZAPF_DINGBATS": "ZapfDingbats",
}
STAMP_CHARACTERS, STAMP_SIZE, SIGNATURE_SCALE = 30, 60.0, 0.3
# What a form offers for stamps.
STAMP_TURN, STAMP_OPACITY = (0, 90), (10, 80)


# The characters of the fonts' encoding beyond ASCII and the upper half of Latin-1.
MORE_CHARACTERS = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
#: Fonts of other characters than letters, in which no text is written.
OTHER_CHARACTERS = ("SYMBOL", "ZAPF_DINGBATS")


def lacking(text: Column, font_name: Column) -> Column:
    """What is said of a text that a font (by its enumeration name) can't show: its first character that the font lacks,
    also a line break; null if it has all."""
    beyond = F.regexp_extract(text, rf"[^ -~\u00a0-\u00ff{MORE_CHARACTERS}]", 0)
    first = F.when(font_name.isin(*OTHER_CHARACTERS), F.substring(text, 1, 1)).otherwise(beyond)
    return F.when(first != "", F.concat(F.format_string("U+%04X is not available in the font ", F.ascii(first)), font_name))


def font(name: Column) -> Column:
    """The enumeration name of a font, in any case and with hyphens; others and null are HELVETICA."""
    known = F.upper(F.translate(name, "-", "_"))
    return F.when(known.isin(*FONTS), known).otherwise(F.lit("HELVETICA"))


def rgb(colour: Column) -> Column:
    """The low 24 bits of #hex, 0xhex, octal with a leading 0, or decimal; black where malformed."""
    text, digits = F.regexp_replace(colour, "^[+-]", ""), F.regexp_replace(colour, "^[+-]?(#|0[xX]|0(?=[0-7]))?", "")
    minus = F.when(colour.startswith("-"), F.lit(-1)).otherwise(F.lit(1)).cast("long")
    value = (
        F.when(text.rlike("^(#|0[xX])[0-9a-fA-F]{1,8}$"), F.conv(digits, 16, 10).cast("long"))
        .when(text.rlike("^0[0-7]{1,10}$"), F.conv(digits, 8, 10).cast("long"))
        .when(text.rlike("^[0-9]{1,10}$"), text.try_cast("long"))
    )
    signed = minus * value
    return F.coalesce(F.when(signed.between(-(1 << 31), (1 << 31) - 1), signed.bitwiseAND(F.lit(0xFFFFFF))), F.lit(0)).cast("int")


def gray(opacity: Column) -> Column:
    """Opacity as a shade of gray, computed in 32-bit floats and cut to an integer; null outside 0..255."""
    shade = (F.lit(255.0).cast("float") * (F.lit(1.0).cast("float") - opacity.cast("float"))).cast("int")
    return F.when(shade.between(0, 255), shade)


def turned(degrees: Column, x: Column, y: Column) -> Column:
    """The text matrix of a rotation about (x, y)."""
    a = F.radians(degrees)
    return F.array(F.cos(a), F.sin(a), -F.sin(a), F.cos(a), x, y)


def from_top(height: Column, y: Column, h: Column) -> Column:
    """A box's y, measured from the top, as measured from the bottom."""
    return height - y - h


def clamp(low: Column, value: Column, high: Column) -> Column:
    return F.greatest(low, F.least(value, high))


def box(x0: Column, y0: Column, x1: Column, y1: Column, least_width: float = 10.0, least_height: float = 5.0) -> Column:
    """The box between two corners; null if it is not wider and higher than the least."""
    w, h = F.abs(x1 - x0), F.abs(y1 - y0)
    return F.when((w > least_width) & (h > least_height), F.struct(F.least(x0, x1).alias("x"), F.least(y0, y1).alias("y"), w.alias("w"), h.alias("h")))


def stamp_fits(text: Column, degrees: Column, opacity: Column) -> Column:
    """Whether a form would offer a stamp: 1 to 30 characters, a turn of 0 to 90 degrees and an opacity of 10 to 80 %."""
    percent = F.round(opacity * 100)
    return F.coalesce(F.char_length(text).between(1, STAMP_CHARACTERS) & degrees.between(*STAMP_TURN) & percent.between(*STAMP_OPACITY), F.lit(False))
