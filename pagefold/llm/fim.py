"""Fill-in-the-middle: texts cut in three and put in another order, by DuckDB on the Arrow batches of each task.

A text is cut in two steps, into pieces of PIECE code points and then, where a cut falls, one piece into its code points,
so that the list of a text's pieces is a small part of the text. Two hashes of the id say where the cuts are, a third
whether the text stays plain, a fourth in which order the parts stand.
"""

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagefold.llm.common import read, texts

#: Marks of the prefix, the suffix and the middle. Texts that hold one stay plain.
MARKS = ("<P>", "<S>", "<M>")
#: Of 100 texts so many stay plain; of 100 others so many have their suffix first.
PLAIN, SUFFIX_FIRST = 10, 20
#: Code points of a piece, and bytes of text that are cut at once, or one longer text.
PIECE, BYTES = 64, 4 << 20

_CHARS = "regexp_extract_all(coalesce(p[{0}], ''), '(?s).')"
#: Code points i + 1 to j of a text given as pieces.
_CUT = f"""create macro cut(p, i, j) as case when i // {PIECE} = j // {PIECE}
    then array_to_string(list_slice({_CHARS.format(f'i // {PIECE} + 1')}, i % {PIECE} + 1, j % {PIECE}), '')
    else array_to_string(list_slice({_CHARS.format(f'i // {PIECE} + 1')}, i % {PIECE} + 1, {PIECE}), '') || array_to_string(list_slice(p, i // {PIECE} + 2, j // {PIECE}), '')
        || array_to_string(list_slice({_CHARS.format(f'j // {PIECE} + 1')}, 1, j % {PIECE}), '') end"""

_FORMED = f"""with hashed as (select row, text, len(text) as n, sha256($seed || ':' || coalesce(id, '')) as h from batch),
    drawn as (select row, text, n, [('0x' || h[8 * k + 1 : 8 * k + 8])::ubigint for k in range(4)] as h from hashed),
    placed as (select row, text, n, least(h[1] % (n + 1), h[2] % (n + 1))::bigint as a, greatest(h[1] % (n + 1), h[2] % (n + 1))::bigint as b,
        case when n = 0 or contains(text, $p) or contains(text, $s) or contains(text, $m) or h[3] % 100 >= 100 - $plain then 'plain' when h[4] % 100 < $suffix_first then 'spm' else 'psm' end as form from drawn),
    pieces as (select *, case when form <> 'plain' then regexp_extract_all(text, '(?s).{{1,{PIECE}}}') end as p from placed),
    parts as (select *, cut(p, 0, a) as prefix, cut(p, a, b) as middle, cut(p, b, n) as suffix from pieces)
    select row, n, form, case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then b - a end as middle_chars,
        case form when 'psm' then $p || prefix || $s || suffix || $m || middle when 'spm' then $s || suffix || $p || prefix || $m || middle else text end as output
    from parts order by row"""

# no part holds a mark, and a mark neither begins nor ends as another ends or begins: the first one found is the one put there
_RESTORED = """with opened as (select row, output, form, string_split(output[4:], case form when 'psm' then $s else $p end) as one from batch),
    split as (select *, string_split(one[2], $m) as two from opened)
    select row, case form when 'psm' then one[1] || two[2] || two[1] when 'spm' then two[1] || two[2] || one[1] else output end as text from split order by row"""


def _sliced(batches, column: str) -> Iterator[pa.RecordBatch]:
    """Batches of BYTES of a column's text at most, or one row."""
    for b in batches:
        size = pc.binary_length(b.column(column)).fill_null(0).to_pylist()
        start = held = 0
        for k, n in enumerate(size):
            if held and held + n > BYTES:
                yield b.slice(start, k - start)
                start, held = k, 0
            held += n
        if start < b.num_rows:
            yield b.slice(start)


def _duck():
    import duckdb

    c = duckdb.connect(config={"threads": 1, "temp_directory": ""})
    c.execute(_CUT)
    return c


def _run(c, sql: str, batch: pa.Table, values: dict) -> pa.Table:
    c.register("batch", batch.append_column("row", pa.array(range(batch.num_rows), pa.int64())))
    out = c.sql(sql, params=values).to_arrow_table()
    c.unregister("batch")
    return out


def formed(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = "1", plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST, marks: tuple[str, str, str] = MARKS
) -> DataFrame:
    """One row for each row of docs: doc_id, n (code points), form (plain, psm, spm), prefix_chars, middle_chars (null if
    plain) and output, the text in that form.

    A null text counts as empty, and an empty one is plain. A null id is cut as one whose decimals are the empty string.
    Rows that repeat an id are cut alike at equal lengths. A text is cut whole, however long. Other columns are not carried;
    an empty table gives no rows. marks: of three characters each.
    """
    if any(len(m) != 3 for m in marks) or len(set(marks)) < 3 or any(x.startswith(y[-k:]) for x in marks for y in marks for k in (1, 2)):
        raise ValueError("three marks of three characters are wanted, none of which begins as one ends")
    d = texts(docs, id_col, text_col).withColumn("id", F.col("doc_id").cast("string"))
    values = {"seed": seed, "plain": plain, "suffix_first": suffix_first} | dict(zip("psm", marks, strict=True))
    kind = d.schema["doc_id"].dataType.simpleString()

    def run(batches):
        c = _duck()
        for b in _sliced(batches, "text"):
            out = _run(c, _FORMED, pa.Table.from_batches([b.select(["id", "text"])]), values)
            columns = [b.column("doc_id"), *(out.column(x).combine_chunks().cast(t) for x, t in (("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return d.mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(forms: DataFrame, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """forms, rows of formed() with the same marks, and text: what each was made of, rebuilt from output and form alone."""
    values = dict(zip("psm", marks, strict=True))

    def run(batches):
        c = _duck()
        for b in _sliced(batches, "output"):
            out = _run(c, _RESTORED, pa.Table.from_batches([b.select(["output", "form"])]), values)
            yield pa.RecordBatch.from_arrays([*b.columns, out.column("text").combine_chunks().cast(pa.string())], [*b.schema.names, "text"])

    return forms.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in forms.schema) + ", text string")


def query(spark, sf_dir: str) -> DataFrame:
    both = restored(formed(read(spark, sf_dir, "documents")))
    return both.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("text", 256).alias("restored_sha256"))


SQL = """with hashed as (select doc_id, coalesce(text, '') as text, length(coalesce(text, '')) as n, sha256('1:' || coalesce(doc_id::varchar, '')) as h from documents),
    drawn as (select *, ('0x' || substr(h, 1, 8))::ubigint as h1, ('0x' || substr(h, 9, 8))::ubigint as h2, ('0x' || substr(h, 17, 8))::ubigint as h3, ('0x' || substr(h, 25, 8))::ubigint as h4 from hashed),
    placed as (select *, least(h1 % (n + 1), h2 % (n + 1))::bigint as a, greatest(h1 % (n + 1), h2 % (n + 1))::bigint as b,
        case when n = 0 or text like '%<P>%' or text like '%<S>%' or text like '%<M>%' or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form from drawn),
    parts as (select *, substr(text, 1, a) as prefix, substr(text, a + 1, b - a) as middle, substr(text, b + 1) as suffix from placed)
    select doc_id, n, form, case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then b - a end as middle_chars,
        sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
        sha256(text) as restored_sha256 from parts"""
