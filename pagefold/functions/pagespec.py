"""Page selections as arrays. A malformed selection is null: one row fails, not the job."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagefold.functions import intervals

INTS = "array<int>"
# What is said of numbers and ranges that can't be read.
NOT_A_NUMBER = "For input string: "
OUT_OF_BOUNDS = "Index {0} out of bounds for length {0}"


def _trim(text: Column) -> Column:
    """Without characters up to U+0020 at both ends."""
    return F.regexp_replace(text, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def _int(text: Column) -> Column:
    return F.when(_trim(text).rlike(r"^[+-]?[0-9]+$"), _trim(text).try_cast("int"))


def integer(text: Column) -> Column:
    """A 32-bit integer, trimmed; null if it is none."""
    return _int(text)


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _items(text: Column) -> Column:
    """Comma-separated items without trailing empty ones."""
    return F.when(text.rlike(r"^,+$"), F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(text, ",+$", ""), ","))


def ints(text: Column) -> Column:
    """'1, 3,2' as an array, in order and with duplicates; ranges are malformed."""
    return _let(F.transform(_items(text), _int), lambda a: F.when(~F.exists(a, lambda x: x.isNull()), a))


def group(text: Column, n: Column) -> Column:
    """'1-3,5' as the pages of 1..n in order of first mention. All bounds are read before they are clipped, so a bad bound
    fails even beyond n; a third field of a range is not looked at."""

    def bounds(item: Column) -> Column:
        parts = F.split(item, "-")
        first = _int(F.element_at(parts, 1))
        last = F.when(F.contains(item, F.lit("-")), _int(F.try_element_at(parts, F.lit(2)))).otherwise(first)
        return F.struct(F.greatest(first, F.when(first.isNotNull(), F.lit(1))).alias("lo"), F.when(first.isNotNull(), F.least(last, F.when(last.isNotNull(), n))).alias("hi"))

    def pages(b: Column) -> Column:
        return F.when(b.lo <= b.hi, F.sequence(b.lo, b.hi)).otherwise(F.array().cast(INTS))

    return _let(
        F.transform(_items(text), bounds),
        lambda a: F.when(~F.exists(a, lambda b: b.lo.isNull() | b.hi.isNull()), F.array_distinct(F.flatten(F.transform(a, pages)))),
    )


def groups(text: Column, n: Column) -> Column:
    """'1-2;4' as arrays of pages. Null or blank: a group for each page. Empty groups keep their place; trailing ones go."""
    blank = F.coalesce(_trim(text) == "", F.lit(True))
    each = F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda p: F.array(p))).otherwise(F.array().cast("array<array<int>>"))
    parts = F.when(text.rlike("^;+$"), F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(text, ";+$", ""), ";"))
    return F.when(blank, each).otherwise(_let(F.transform(parts, lambda g: group(g, n)), lambda a: F.when(~F.exists(a, lambda g: g.isNull()), a)))


def _form(text: Column, most: int) -> Column:
    """The intervals that ranges() unfolds, in the order of the text."""

    def found(item: Column) -> Column:
        one, parts = _int(item), F.split(item, "-")
        lo, hi = _int(F.element_at(parts, 1)), _int(F.try_element_at(parts, F.lit(2)))
        wide = F.contains(item, F.lit("-")) & (lo >= 1) & (lo <= hi)
        # an empty interval stands for an item that is no number
        return F.when(wide & (hi - lo >= most), F.lit(None)).when(wide, intervals.interval(lo, hi)).when(one >= 1, intervals.interval(one, one)).otherwise(intervals.interval(F.lit(1), F.lit(0)))

    return _let(F.transform(F.split(text, ","), found), lambda a: F.when(~F.exists(a, lambda i: i.isNull()), F.filter(a, lambda i: i["lo"] <= i["hi"])))


def ranges(text: Column, most: int = 100_000) -> Column:
    """'1,3,5-7' as a form reads it: ascending and unique, items that are no numbers left out. A range of over most pages
    makes the row null, so that one text can't ask for more memory than there is."""
    return F.sort_array(F.array_distinct(F.flatten(F.transform(_form(text, most), lambda i: F.sequence(i["lo"].cast("int"), i["hi"].cast("int"))))))


def range_count(text: Column, most: int = 100_000) -> Column:
    """The number of pages that ranges() gives, null where it is; nothing is unfolded."""
    return intervals.covered(_form(text, most)).cast("int")


def range_set(text: Column) -> Column:
    """'1,3,5-7' as a form reads it, as a set of intervals in normal form: of any width, as nothing is unfolded. Items that
    are no numbers of up to 18 digits are left out, as are pages below 1."""

    def number(item: Column) -> Column:
        return F.when(_trim(item).rlike(r"^[+-]?[0-9]{1,18}$"), _trim(item).try_cast("long"))

    def found(item: Column) -> Column:
        one, parts = number(item), F.split(item, "-")
        lo, hi = number(F.element_at(parts, 1)), number(F.try_element_at(parts, F.lit(2)))
        wide = F.contains(item, F.lit("-")) & (lo >= 1) & (lo <= hi)
        return F.when(wide, intervals.interval(lo, hi)).when(one >= 1, intervals.interval(one, one))

    return intervals.merged(F.filter(F.transform(F.split(text, ","), found), lambda i: i.isNotNull()))


def _quoted(text: Column) -> Column:
    return F.concat(F.lit(NOT_A_NUMBER), F.lit('"'), text, F.lit('"'))


def list_cause(text: Column) -> Column:
    """What is said of a malformed list of integers: its first item that is none; null if all are."""
    return _quoted(first_malformed(text))


def groups_cause(text: Column) -> Column:
    """What is said of malformed groups: of the first item, in order, that can't be read; null if all can, or text is blank."""

    def of(item: Column) -> Column:
        parts = F.split(F.regexp_replace(item, "-+$", ""), "-")
        first, last = _trim(F.element_at(parts, 1)), _trim(F.try_element_at(parts, F.lit(2)))
        wide = F.when(_int(first).isNull(), _quoted(first)).when(last.isNull(), F.lit(OUT_OF_BOUNDS.format(1))).when(_int(last).isNull(), _quoted(last))
        return F.when(item.rlike("^-+$"), F.lit(OUT_OF_BOUNDS.format(0))).when(F.contains(item, F.lit("-")), wide).when(_int(item).isNull(), _quoted(item))

    parts = F.when(text.rlike("^;+$"), F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(text, ";+$", ""), ";"))
    each = F.flatten(F.transform(parts, lambda g: F.transform(_items(_trim(g)), lambda i: of(_trim(i)))))
    return F.when(_trim(text) != "", F.try_element_at(F.filter(each, lambda c: c.isNotNull()), F.lit(1)))


def first_malformed(text: Column) -> Column:
    """The first item of a list of integers that is none, trimmed; null if all are."""
    return F.try_element_at(F.transform(F.filter(_items(text), lambda i: _int(i).isNull()), _trim), F.lit(1))


def serialized(selection: Column) -> Column:
    """Arrays of pages as 'a,b;c', without empty groups."""
    return F.array_join(F.transform(F.filter(selection, lambda g: F.size(g) > 0), lambda g: F.array_join(g.cast("array<string>"), ",")), ";")


def left_after(pages: Column, n: Column) -> Column:
    """The pages of 1..n left when pages are deleted one by one, highest first, each by its place among those then left:
    a page named twice takes the next one along."""
    whole = F.when(n > 0, F.sequence(F.lit(1), F.greatest(n, F.lit(1)))).otherwise(F.array().cast(INTS))
    drop = lambda left, p: F.when((p >= 1) & (p <= F.size(left)), F.filter(left, lambda _, k: k != p - 1)).otherwise(left)
    return F.aggregate(F.sort_array(pages, asc=False), whole, drop)
