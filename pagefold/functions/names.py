"""File names: what outputs are called, and which names may be asked for."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Suffixes of the operations, allowed extensions and verdicts.
SUFFIXES = ("merged", "split", "extracted", "removed", "watermarked", "text_added", "signed", "redacted", "markdown", "docx")
EXTENSIONS = ("pdf", "md", "docx")
EMPTY = "Filename cannot be null or empty"
NUL = "Invalid filename: null byte detected"
SEPARATOR = "Invalid filename: path separators are not allowed"
MALFORMED = "Invalid filename: missing or malformed file extension"
EXTENSION = "Invalid filename: only .pdf, .md, or .docx extensions are allowed"
PARENT = "Invalid filename: parent directory references are not allowed"


def stem(name: Column) -> Column:
    """What follows the last separator, without one .pdf at the end; empty where nothing is left."""
    last = F.regexp_extract(F.translate(F.coalesce(name, F.lit("")), "\0", ""), r"([^/\\]*)$", 1)
    return F.regexp_replace(last, r"(?i)\.pdf$", "")


def base_name(name: Column, suffix: str) -> Column:
    """stem_suffix, or the suffix alone without a stem."""
    return F.when(stem(name) == "", F.lit(suffix)).otherwise(F.concat(stem(name), F.lit(f"_{suffix}")))


def output_name(name: Column, suffix: str, extension: str, key: Column | None = None) -> Column:
    """The base name, 8 hexadecimal digits and the extension. key: the digits follow from it; without, they are random."""
    digits = F.substring(F.expr("uuid()"), 1, 8) if key is None else F.substring(F.sha2(key.cast("string"), 256), 1, 8)
    return F.concat(base_name(name, suffix), F.lit("_"), digits, F.lit(f".{extension}"))


def part_name(name: Column, kind: str, number: Column, key: Column | None = None) -> Column:
    """The name of one of the documents that a split makes: base name, kind (page or part) with its number, 8 digits. key: as
    in output_name(); the digits follow from it and the number."""
    digits = F.substring(F.expr("uuid()"), 1, 8) if key is None else F.substring(F.sha2(F.concat_ws(":", key.cast("string"), F.lit(kind), number.cast("string")), 256), 1, 8)
    return F.concat(base_name(name, "split"), F.lit(f"_{kind}"), number.cast("string"), F.lit("_"), digits, F.lit(".pdf"))


def settled(files: DataFrame, order: Sequence[str], name: str = "name") -> DataFrame:
    """files, one row for each name: the last one in order of some columns, as it would be found after all were written, with
    n_writers. Of rows alike in those, the one of greatest other columns; rows without a name are left out."""
    rest = [c for c in files.columns if c not in order and c != name and files.schema[c].dataType.typeName() != "map"]
    last = F.max_by(F.struct(*files.columns), F.struct(*order, *rest))
    return files.filter(F.col(name).isNotNull()).groupBy(F.col(name).alias("__name")).agg(last.alias("__last"), F.count("*").alias("n_writers")).select("__last.*", "n_writers")


def clashes(files: DataFrame, name: str = "name") -> DataFrame:
    """job_id, name, n_writers of names that a job would write more than once."""
    return files.filter(F.col(name).isNotNull()).groupBy("job_id", F.col(name).alias("name")).agg(F.count("*").alias("n_writers")).filter("n_writers > 1")


def verdict(name: Column) -> Column:
    """The first rule that a name breaks, or OK."""
    head, tail = F.regexp_extract(name, r"(?s)^(.*)\.([^.]*)$", 1), F.regexp_extract(name, r"(?s)^(.*)\.([^.]*)$", 2)
    return (
        F.when(name.isNull() | (F.regexp_replace(name, r"[\x00-\x20]+", "") == ""), F.lit(EMPTY))
        .when(F.contains(name, F.lit("\0")), F.lit(NUL))
        .when(name.rlike(r"[/\\]"), F.lit(SEPARATOR))
        .when((head == "") | (tail == ""), F.lit(MALFORMED))
        .when(~F.lower(tail).isin(*EXTENSIONS), F.lit(EXTENSION))
        .when(head == "..", F.lit(PARENT))
        .otherwise(F.lit("OK"))
    )


def download_name(name: Column, suffix: str, extension: str = "pdf") -> Column:
    """What a browser saves an output as."""
    return F.concat(F.regexp_replace(name, r"(?i)\.pdf$", ""), F.lit(f"_{suffix}.{extension}"))
