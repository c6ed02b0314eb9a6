"""Extracted text as Markdown and as paragraphs."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the output formats.
HEADING = "# PDF Content\n\n"
NO_TEXT = "[No extractable text found in this PDF. The document may contain only images or scanned content.]"
SPACE = r"[\x00-\x20]+"


def is_blank(text: Column) -> Column:
    return F.coalesce(F.regexp_replace(text, SPACE, "") == "", F.lit(True))


def markdown(text: Column) -> Column:
    """A heading, then each line as it is and an empty line; a blank line gives one line break; trailing empty lines go."""
    lines = F.split(F.regexp_replace(text, r"\n+$", ""), "\n")
    body = F.array_join(F.transform(lines, lambda x: F.when(F.regexp_replace(x, SPACE, "") == "", F.lit("\n")).otherwise(F.concat(x, F.lit("\n\n")))), "")
    return F.concat(F.lit(HEADING), F.when(is_blank(text), F.lit(NO_TEXT)).otherwise(body))


def paragraphs(text: Column) -> Column:
    """The parts between empty lines, trimmed, without empty ones."""
    trimmed = F.transform(F.split(text, "\n\n"), lambda x: F.regexp_replace(x, rf"^{SPACE}|{SPACE}$", ""))
    return F.when(is_blank(text), F.array(F.lit(NO_TEXT))).otherwise(F.filter(trimmed, lambda x: x != ""))
