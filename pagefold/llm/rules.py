"""Quality rules as a bitmask ledger, in built-in Spark functions only.

measure() reads each text once. ledger() evaluates every rule once and stores the failures as bits next to the
measurements. Policies are masks over those bits: apply() and ablations() need the ledger alone, never the texts.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagefold.llm.common import texts

# Fixed values of the contract.
WORD = r"[^\x20\x09-\x0D]+"
WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

#: Rules in the order of their bits. All are integer comparisons, so every engine decides alike.
RULES: dict[str, Callable[[], Column]] = {
    "few_words": lambda: F.col("n_words") < 50,
    "repeated_words": lambda: 100 * F.col("n_repeat_words") > 50 * F.col("n_words"),
    "symbols": lambda: 100 * F.col("n_symbols") > 25 * F.col("n_words"),
    "repeated_lines": lambda: 100 * F.col("n_dup_lines") > 50 * F.col("n_lines"),
    "long_words": lambda: F.col("word_chars") > 20 * F.col("n_words"),
    "short_words": lambda: F.col("word_chars") < 2 * F.col("n_words"),
    "shouting": lambda: 100 * F.col("n_bangs") > 50 * F.col("n_words"),
}
BASE = ("few_words", "repeated_words")


def mask(*rules: str) -> int:
    return sum(1 << list(RULES).index(r) for r in rules)


#: Policies by version; a document is kept if it fails none of the policy's rules.
POLICIES = {"base": mask(*BASE), "v1": mask(*BASE, "symbols", "repeated_lines"), "v2": mask(*RULES)}


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once for each row, however often lambdas inside body use it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeated(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more. Windows are told apart by 64-bit hashes; sorting them with
    their positions brings equal ones together, so the work is n log n in the words of a text."""
    windows = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")),
    )
    twice = lambda s: F.filter(s, lambda x, k: (x.h == F.get(s, k - 1).h) | (x.h == F.get(s, k + 1).h))
    covered = lambda t: F.array_distinct(F.flatten(F.transform(t, lambda x: F.array(x.i, x.i + 1, x.i + 2))))
    return F.when(F.size(words) < 3, F.lit(0)).otherwise(F.size(_let(F.sort_array(windows), lambda s: covered(twice(s)))))


def _count(text: Column, characters: str) -> Column:
    return F.char_length(text) - F.char_length(F.translate(text, characters, ""))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id and the measurements, all long.

    A null or empty text measures 0 everywhere. Repeated rows give repeated rows; other columns are not carried.
    """
    d = texts(docs, id_col, text_col).select(
        "doc_id", "text", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"), F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD)).alias("lines")
    )
    return d.select(
        "doc_id",
        *(
            value.cast("long").alias(name)
            for name, value in {
                "n_words": F.size("words"),
                "word_chars": F.char_length("text") - _count(F.col("text"), WHITE),
                "n_symbols": _count(F.col("text"), SYMBOLS),
                "n_dup_lines": _let(F.col("lines"), lambda x: F.size(x) - F.size(F.array_distinct(x))),
                "n_repeat_words": _let(F.col("words"), _repeated),
                "n_lines": F.size("lines"),
                "n_bangs": _count(F.col("text"), "!"),
            }.items()
        ),
    )


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """measure() and failures: a long whose bit k is set if rule k of RULES failed."""
    bits = [F.when(rule(), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, rule in enumerate(RULES.values())]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return measure(docs, id_col, text_col).withColumn("failures", out)


def apply(book: DataFrame, policy: str = "v2") -> DataFrame:
    """The ledger with base_failed and kept under a policy."""
    hit = lambda m: F.col("failures").bitwiseAND(F.lit(m)) != 0
    return book.withColumn("base_failed", hit(POLICIES["base"])).withColumn("kept", ~hit(POLICIES["base"] | POLICIES[policy]))


def ablations(book: DataFrame, policy: str = "v2") -> DataFrame:
    """For each rule of a policy: rows that fail it, and rows that would be kept without it. One aggregation over the
    distinct failure masks (at most 2 to the number of rules), whatever the number of rows."""
    m = POLICIES[policy]
    rules = F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(mask(r)).cast("long").alias("bit")) for r in RULES if m & mask(r)))
    seen = book.groupBy(F.col("failures").bitwiseAND(F.lit(m)).alias("failures")).agg(F.count("*").alias("n"))
    return (
        seen.select("failures", "n", F.explode(rules).alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(F.col("failures").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(F.col("failures") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only_this"),
        )
    )


#: The rows of op7 in DuckDB.
SQL = r"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
w as (select r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from d),
g as (select r, unnest(range(1, len(words) - 1)) as i, words from w),
t as (select r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] as tri from g),
twice as (select r, i from (select r, i, count(*) over (partition by r, tri) as n from t) where n > 1),
cover as (select r, count(distinct i + k) as n from twice, (values (0), (1), (2)) o(k) group by r),
m as (select w.doc_id, cast(len(words) as bigint) as n_words,
    cast(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) as bigint) as word_chars,
    cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
    cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines,
    cast(coalesce(cover.n, 0) as bigint) as n_repeat_words,
    cast(len(lines) as bigint) as n_lines,
    cast(length(text) - length(replace(text, '!', '')) as bigint) as n_bangs
    from w left join cover using (r)),
b as (select *, cast((n_words < 50)::int + 2 * (100 * n_repeat_words > 50 * n_words)::int + 4 * (100 * n_symbols > 25 * n_words)::int
    + 8 * (100 * n_dup_lines > 50 * n_lines)::int + 16 * (word_chars > 20 * n_words)::int + 32 * (word_chars < 2 * n_words)::int
    + 64 * (100 * n_bangs > 50 * n_words)::int as bigint) as failures from m)
select *, failures & 3 <> 0 as base_failed, failures = 0 as kept from b
"""


def query(spark, sf_dir: str) -> DataFrame:
    from pagefold.llm.common import read

    return apply(ledger(read(spark, sf_dir, "documents")))
