"""Queries of requests with parameters of their own, each with DuckDB SQL for the same rows.

As in catalog.py, documents are conversations. Each conversation, event or page of the given tables states a request.
"""

from pyspark.sql import functions as F

from pagefold.functions import drawing, intervals, names, pagespec
from pagefold.operators import edits, overlays, pages, requests, results, selections
from pagefold.plans.catalog import BOXES, COUNTS, _pages, _read
from pagefold.sources import committed, documents, files, images


def _c():
    return F.col("doc_id")


def _text(*parts):
    return F.concat(*(p.cast("string") if not isinstance(p, str) else F.lit(p) for p in parts))


def _docs(spark, d):
    return _pages(spark, d).select("doc_id").distinct()


def _lists(spark, d):
    """Two lists for each document; one in eleven of the first kind is malformed."""
    docs = _docs(spark, d)
    first = docs.select((_c() * 2).alias("job_id"), "doc_id", F.concat(_text(_c() % 4 + 1, " , ", _c() % 7 + 1, ",", _c() % 4 + 1), F.when(_c() % 11 == 0, F.lit(",5-7")).otherwise(F.lit(""))).alias("spec"))
    return first.union(docs.select((_c() * 2 + 1).alias("job_id"), "doc_id", (_c() % 9).cast("string").alias("spec")))


def _groups(spark, d):
    return _docs(spark, d).select(_c().alias("job_id"), "doc_id", F.concat(_text(_c() % 3 + 1, "-", _c() % 5 + 1, ",2;99;", _c() % 4 + 1), F.when(_c() % 13 == 0, F.lit(";3-")).otherwise(F.lit(""))).alias("spec"))


def own_extracts(spark, d):
    return selections.extracted(_pages(spark, d), _lists(spark, d))


def own_removals(spark, d):
    return selections.left(_pages(spark, d), _lists(spark, d)).drop("text")


def own_removals_each(spark, d):
    return selections.left(_pages(spark, d), _lists(spark, d), one_by_one=True).drop("text")


def own_groups(spark, d):
    return selections.parts(_pages(spark, d), _groups(spark, d)).drop("text")


def own_unassigned(spark, d):
    return selections.unassigned(_pages(spark, d), _groups(spark, d))


def own_outcomes(spark, d):
    listed = selections.outcomes(_pages(spark, d), _lists(spark, d).filter("job_id % 2 = 0"), "extract")
    return listed.select("doc_id", F.lit("extract").alias("kind"), "success", "n_pages", "cause").union(
        selections.outcomes(_pages(spark, d), _groups(spark, d), "split").select("doc_id", F.lit("split"), "success", "n_pages", "cause")
    )


def range_sets(spark, d):
    e = F.col("event_id")
    text = _text(e % 5, ",9,", e % 4, "-", F.element_at(F.array(F.lit("3"), F.lit("2000000000"), F.lit("100000")), (e % 3 + 1).cast("int")), ",x")
    held = _read(spark, d, "events").select("event_id", pagespec.range_set(text).alias("s"))
    there = intervals.within(F.col("s"), F.lit(50))
    return held.select("event_id", intervals.count(F.col("s")).alias("n"), F.size("s").alias("n_intervals"), intervals.count(there).alias("n_there"), intervals.count(intervals.gaps(there, F.lit(50))).alias("n_left"))


def _steps(spark, d):
    docs = _docs(spark, d)
    step = lambda k, op, spec=None, start=None, target=None, of=None: docs.select(
        _c().alias("job_id"), F.lit(k).alias("step"), F.lit(op).alias("op"), (spec if spec is not None else F.lit(None)).cast("string").alias("spec"),
        F.lit(start).cast("long").alias("start"), F.lit(target).cast("long").alias("target"), (of if of is not None else F.lit(None)).cast("long").alias("doc_id"),
    )
    all_ = [
        step(1, "merge", of=_c()), step(2, "move", start=0, target=2), step(3, "remove", F.lit("1")), step(4, "extract", F.when(_c() % 5 == 0, F.lit("2,x")).otherwise(F.lit("2,1,2"))),
        step(5, "merge", of=_c() + 1), step(6, "drop", start=0),
    ]
    out = all_[0]
    for s in all_[1:]:
        out = out.union(s)
    return out


def edited_pages(spark, d):
    p = _pages(spark, d)
    return edits.edited(p, edits.composed(_steps(spark, d), p)).drop("text")


def edit_outcomes(spark, d):
    return edits.edit_outcomes(edits.composed(_steps(spark, d), _pages(spark, d)))


OPERATIONS = (*requests.ROUTES, "nothing")
LIMIT = 50_000


def _request_table(spark, d):
    """A route for each event, by turns, with one of five choices of parameters."""
    e, v, doc = F.col("event_id"), F.col("v"), F.col("d")
    base = _read(spark, d, "events").select(
        "event_id", F.element_at(F.array(*map(F.lit, OPERATIONS)), (e % len(OPERATIONS) + 1).cast("int")).alias("operation"), (F.floor(e / 14) % 60).cast("long").alias("d"), (F.floor(e / 7) % 5).cast("int").alias("v"),
    )
    choose = lambda *c: F.element_at(F.array(*(F.create_map(*[F.lit(x) if isinstance(x, str) else x for x in one]).cast("map<string,string>") if one else F.create_map().cast("map<string,string>") for one in c)), v + 1)
    box = ("x", "1", "y", "2", "width", "3")
    listed = choose((), ("pages", "3, 1"), ("pages", "5-7"), ("pages", "99"), ("pages", ""))
    params = {
        "split": choose((), ("groups", "1-2;2,99;99;3"), ("groups", "1;x"), ("groups", "3-"), ("groups", ";")),
        "extract": listed, "remove": listed,
        "watermark": choose((), ("text", "DRAFT"), ("text", "DRAFT", "opacity", "1.5"), ("text", "DRAFT", "opacity", "x"), ("text", "a中")),
        "add-text": choose((), ("text", "hello"), ("text", "hello", "page", " 4 "), ("text", "hello", "page", "x"), ("text", "a\nb", "fontName", "courier")),
        "add-signature": choose((), (), ("page", "9"), (), ("x", "q")),
        "redact": choose(box, (*box, "height", "4"), (*box, "height", "4", "page", "4"), (*box[2:], "height", "4", "x", " "), (*box, "height", "h")),
        "redact-multiple": choose((), ("redactions", "[]"), ("redactions", "nope"), ("redactions", '[{"x":"NaN","y":1,"width":1,"height":1,"pageNum":1}]'), ("redactions", "\n" + BOXES)),
        "download": choose(("filename", "../x.pdf"), ("filename", _text("file", doc, ".pdf")), ("filename", "x.exe"), ("filename", ""), ()),
    }
    png = F.unhex(F.lit("89504E470D0A1A0A0000000D4948445200000064000000320806000000"))
    image = F.when((F.col("operation") == "add-signature") & (v > 0), F.when(v == 3, F.lit("GIF89a").cast("binary")).otherwise(png))
    of = F.when(e % 23 == 0, F.array().cast("array<bigint>")).when(F.col("operation") == "merge", F.array(doc, doc + 1)).when(F.col("operation") == "download", F.array().cast("array<bigint>")).otherwise(F.array(doc))
    chosen = F.lit(None).cast("map<string,string>")
    for route, p in params.items():
        chosen = F.when(F.col("operation") == route, p).otherwise(chosen)
    return base.select(e.alias("job_id"), "operation", of.alias("doc_ids"), _text("doc", doc, ".PDF").alias("name"), chosen.alias("params"), image.alias("image"))


def _known(spark, d):
    counts = pages.page_counts(_pages(spark, d))
    return counts.select("doc_id", "page_count", (_c() * 1000).alias("length"), F.when(_c() % 17 == 0, F.lit("encrypted files are not read")).alias("error"))


def request_results(spark, d):
    stored = _read(spark, d, "pages").filter("page_id % 2 = 0").select(_text("file", F.col("page_id"), ".pdf").alias("name"))
    out = requests.answered(_request_table(spark, d), _known(spark, d), stored, most_bytes=LIMIT)
    return out.select("job_id", "operation", "status", "success", "message", F.array_join("outputs", ",").alias("outputs"))


def _offered(spark, d):
    return _read(spark, d, "pages").select((F.col("page_id") % 40).alias("job_id"), F.col("page_id").alias("pos"), (F.octet_length("html") * (F.col("page_id") % 40)).cast("long").alias("length"))


def request_limits(spark, d):
    return files.refused(_offered(spark, d), most_file=100_000, most_request=200_000)


def files_within_limits(spark, d):
    return files.limited(_offered(spark, d), most_file=100_000, most_request=200_000).filter(~F.col("refused")).drop("refused")


def split_names(spark, d):
    p = F.col("page_id")
    name = names.part_name(F.col("url"), "part", p % 3 + 1, p % 10)
    return _read(spark, d, "pages").select("page_id", name.alias("name"), names.part_name(F.lit(None).cast("string"), "page", p % 3 + 1, p).alias("page_name"))


def _written(spark, d):
    p = F.col("page_id")
    return _read(spark, d, "pages").select((p % 5).alias("job_id"), p.alias("pos"), names.part_name(F.lit("plan.pdf"), "part", p % 3 + 1, p % 10).alias("name"))


def name_clashes(spark, d):
    return names.clashes(_written(spark, d))


def last_writers(spark, d):
    return names.settled(_written(spark, d), ["job_id", "pos"])


def stamp_status(spark, d):
    text = F.when(_c() % 5 == 0, F.lit("naïve 中")).otherwise(F.lit("plain ü"))
    return overlays.stamp_status(_docs(spark, d), (_c() % 16 - 2) / 10, text)


def texts_status(spark, d):
    p = _pages(spark, d)
    item = lambda seq, page, text, font: _docs(spark, d).select("doc_id", F.lit(seq).alias("seq"), F.lit(page).alias("page_no"), text.alias("text"), F.lit(font).alias("font"))
    items = item(1, 1, F.lit("fine €"), "Times-Roman").union(item(2, 4, F.when(_c() % 3 == 0, F.lit("two\nlines")).otherwise(F.lit("ok")), "nonesuch")).union(item(3, 1, F.when(_c() % 4 == 0, F.lit("ok")).otherwise(F.lit("")), "symbol"))
    return overlays.checked_texts(p, items)


def lacking_characters(spark, d):
    """The first character of each document's text that a font lacks."""
    return _read(spark, d, "documents").select("doc_id", drawing.lacking(F.translate("text", "\n", " "), F.lit("COURIER")).alias("cause"))


def jpeg_sizes(spark, d):
    e = F.col("event_id")
    number = lambda k: F.lpad(F.hex(e % k + 1), 4, "0")
    hexed = F.concat(F.lit("FFD8"), F.repeat(F.lit("FFE000046162"), (e % 90).cast("int")), F.repeat(F.lit("FF"), (e % 3).cast("int")), F.lit("FFC0000B08"), number(613), number(977), F.lit("01011100FFD9"))
    size = images.size(F.col("content"))
    return _read(spark, d, "events").select("event_id", F.unhex(hexed).alias("content")).select("event_id", size["width"].alias("width"), size["height"].alias("height"))


def raised_lines(spark, d):
    """Words of conversations laid out five to a line, of which some stand a point or two lower."""
    word = lambda w, i: F.struct((F.floor(i / 5) * 14.0 + i % 3).cast("double").alias("y"), (i % 5 * 10.0).cast("double").alias("x"), w.alias("text"))
    return _pages(spark, d).select("doc_id", "page_no", documents.lines(F.shuffle(F.transform(F.split("text", " "), word))).alias("text"))


def _stored(spark, d):
    name = _text("file", F.col("page_id"), F.element_at(F.array(F.lit(".pdf"), F.lit(".md"), F.lit(".txt")), (F.col("page_id") % 3 + 1).cast("int")))
    return _read(spark, d, "pages").select("page_id", name.alias("name"), F.encode("html", "UTF-8").alias("content"))


def committed_files(spark, d):
    folder = files.new_folder(spark)
    committed.write_files(_stored(spark, d), folder)
    return files.loaded(spark, folder, "*").select("name", "length", F.sha2("content", 256).alias("sha256"))


def downloads(spark, d):
    folder = files.new_folder(spark)
    committed.write_files(_stored(spark, d).filter("page_id % 4 > 0"), folder)
    asked = _stored(spark, d).select(F.when(F.col("page_id") % 7 == 0, F.concat(F.lit("../"), F.col("name"))).otherwise(F.col("name")).alias("name"))
    return files.download(spark, asked, folder).select("name", "verdict", F.octet_length("content").cast("long").alias("length"))


QUERIES = {
    f.__name__: f
    for f in (
        own_extracts, own_removals, own_removals_each, own_groups, own_unassigned, own_outcomes, range_sets, edited_pages, edit_outcomes, request_results, request_limits, files_within_limits,
        split_names, name_clashes, last_writers, stamp_status, texts_status, lacking_characters, jpeg_sizes, raised_lines, committed_files, downloads,
    )
}

_LISTS = """(select c * 2 as job_id, c, k, case k when 2 then c % 7 + 1 else c % 4 + 1 end as p from (select distinct conv_id as c from conversations) cross join (values (1), (2), (3)) v(k) where c % 11 <> 0
    union all select c * 2 + 1, c, 1, c % 9 from (select distinct conv_id as c from conversations))"""
_PARTS = """(select c, 1 as part_no, p as pos, p from (select distinct conv_id as c from conversations), lateral (select unnest(range(c % 3 + 1, c % 5 + 2)) as p) where c % 13 <> 0
    union all select c, 1, 100, 2 from (select distinct conv_id as c from conversations) where c % 13 <> 0 and not 2 between c % 3 + 1 and c % 5 + 1
    union all select c, 3, 1, c % 4 + 1 from (select distinct conv_id as c from conversations) where c % 13 <> 0)"""
_EDITED = """with p as (select conv_id as c, turn + 1 as k, count(*) over (partition by conv_id) as n from conversations),
    moved as (select c, k as src, case when n < 3 then k when k = 1 then 3 when k <= 3 then k - 1 else k end as pos from p),
    cut as (select c, src, pos - 1 as pos from moved where pos <> 1),
    chosen as (select c, src, row_number() over (partition by c order by q) as pos from cut join (values (1, 2), (2, 1), (3, 2)) v(q, w) on pos = w where c % 5 <> 0),
    joined as (select c, c as doc, src, pos from chosen union all select x.c, p.c, p.k, coalesce(m.n, 0) + p.k from (select distinct c from p where c % 5 <> 0) x join p on p.c = x.c + 1
        left join (select c, count(*) as n from chosen group by c) m on m.c = x.c),
    fine as (select c from p where c % 5 <> 0 and c + 1 in (select c from p) group by c)"""
_HEX = "left(sha256({}), 8)"
_PART_NAME = _HEX.format("(page_id % 10) || ':part:' || (page_id % 3 + 1)")
_STEM = r"regexp_replace(regexp_extract(url, '([^/\\]*)$', 1), '\.[pP][dD][fF]$', '')"

ORACLE_SQL = {
    "own_extracts": f"select job_id, cast(row_number() over (partition by job_id order by k) as integer) as out_page, c as doc_id, turn + 1 as src_page, text from {_LISTS} join conversations on conv_id = c and turn + 1 = p",
    "own_removals": f"""select job_id, cast(row_number() over (partition by job_id order by turn) as integer) as out_page, c as doc_id, turn + 1 as src_page from (select distinct job_id, c from {_LISTS}) j
        join conversations on conv_id = c anti join {_LISTS} l on l.job_id = j.job_id and l.p = turn + 1""",
    "own_removals_each": f"""with l as {_LISTS}, q as (select job_id, c, turn + 1 as q from (select distinct job_id, c from l) join conversations on conv_id = c),
        f as (select q.job_id, q.q, a.q as a, (select count(*) from l where l.job_id = q.job_id and l.p between a.q and q.q) as n from q join q a on a.job_id = q.job_id and a.q <= q.q),
        gone as (select distinct job_id, q from f where n >= q - a + 1)
        select job_id, cast(row_number() over (partition by job_id order by q) as integer) as out_page, c as doc_id, q as src_page from q anti join gone using (job_id, q)""",
    "own_groups": f"select c as job_id, part_no, cast(row_number() over (partition by c, part_no order by pos) as integer) as out_page, c as doc_id, turn + 1 as src_page from {_PARTS} join conversations on conv_id = c and turn + 1 = p",
    "own_unassigned": f"select conv_id as job_id, conv_id as doc_id, turn + 1 as page_no from conversations anti join {_PARTS} g on g.c = conv_id and g.p = turn + 1 where conv_id % 13 <> 0",
    "own_outcomes": f"""select doc_id, 'extract' as kind, doc_id % 11 <> 0 as success, case when doc_id % 11 <> 0 then 2 * (doc_id % 4 + 1 <= n)::bigint + (doc_id % 7 + 1 <= n)::bigint end as n_pages,
        case when doc_id % 11 = 0 then 'For input string: "5-7"' end as cause from {COUNTS}
        union all select doc_id, 'split', doc_id % 13 <> 0, case when doc_id % 13 <> 0 then (select count(*) from {_PARTS} g where g.c = doc_id and g.p <= n) end,
        case when doc_id % 13 = 0 then 'Index 1 out of bounds for length 1' end from {COUNTS}""",
    "range_sets": """with e as (select event_id, event_id % 5 as a, event_id % 4 as lo, [3, 2000000000, 100000][event_id % 3 + 1] as hi from events),
        s as (select event_id, case when lo >= 1 then lo end as lo, case when lo >= 1 then hi end as hi, a >= 1 and (lo = 0 or a < lo or a > hi) as alone, a, lo = 0 or hi = 3 as nine from e)
        select event_id, coalesce(hi - lo + 1, 0) + alone::bigint + nine::bigint as n,
            cast(nine::int + (lo is not null)::int + (alone and (lo is null or a < lo - 1 or a > hi + 1))::int as integer) as n_intervals,
            coalesce(least(hi, 50) - lo + 1, 0) + alone::bigint + nine::bigint as n_there, 50 - (coalesce(least(hi, 50) - lo + 1, 0) + alone::bigint + nine::bigint) as n_left from s""",
    "edited_pages": f"{_EDITED} select c as job_id, cast(pos - 1 as integer) as out_page, doc as src_doc, src as src_page from joined where c in (select c from fine) and pos > 1",
    "edit_outcomes": f"""{_EDITED} select c as job_id, c in (select c from fine) as success, case when c in (select c from fine) then (select count(*) from joined j where j.c = x.c and j.pos > 1) end as n_pages,
        case when c in (select c from fine) then '{results.DONE['merge']}' when c % 5 = 0 then '{results.FAILED['extract']}: For input string: "x"' else '{results.FAILED['merge']}: {edits.NO_DOCUMENT}' end as message from (select distinct c from p) x""",
    "request_results": f"""with e as (select event_id as job_id, [{', '.join(f"'{o}'" for o in OPERATIONS)}][event_id % {len(OPERATIONS)} + 1] as operation, event_id // 14 % 60 as d, event_id // 7 % 5 as v from events),
        k as (select doc_id, n, doc_id * 1000 as length, case when doc_id % 17 = 0 then 'encrypted files are not read' end as error from {COUNTS}),
        f as (select e.*, operation <> 'download' as files, job_id % 23 = 0 as none, coalesce(a.n, 0) as n, a.length as l1, case when operation = 'merge' then b.length end as l2,
            coalesce(case when a.doc_id is null then 'no such document' else a.error end, case when operation = 'merge' then case when b.doc_id is null then 'no such document' else b.error end end) as unread
            from e left join k a on a.doc_id = d left join k b on b.doc_id = d + 1),
        g as (select *, case operation when 'merge' then 'Failed to merge PDFs' when 'split' then 'Failed to split PDF' when 'extract' then 'Failed to extract pages' when 'remove' then 'Failed to remove pages' when 'watermark' then 'Failed to add watermark'
            when 'add-text' then 'Failed to add text' when 'add-signature' then 'Failed to add signature' when 'redact' then 'Failed to redact content' when 'redact-multiple' then 'Failed to redact content'
            when 'convert/markdown' then 'Failed to convert to Markdown' when 'convert/docx' then 'Failed to convert to DOCX' when 'info' then 'Failed to get PDF info' end as failed,
            case when v = 0 then case operation when 'extract' then 'pages' when 'remove' then 'pages' when 'watermark' then 'text' when 'add-text' then 'text' when 'redact' then 'height' when 'redact-multiple' then 'redactions' end
                when v = 3 and operation = 'redact' then 'x' end as missing,
            case when operation in ('extract', 'remove') then case v when 2 then 'For input string: "5-7"' when 4 then 'For input string: ""' end end as bad,
            case operation when 'split' then case v when 2 then 'For input string: "x"' when 3 then 'Index 1 out of bounds for length 1' end
                when 'watermark' then case when n > 0 and v = 2 then '{overlays.BAD_SHADE}' when n > 0 and v = 4 then 'U+4E2D is not available in the font HELVETICA_BOLD' end
                when 'add-text' then case when n < 1 or v = 2 and n < 4 then 'Invalid page number' when v = 4 then 'U+000A is not available in the font COURIER' end
                when 'add-signature' then case when n < 1 or v = 2 then 'Invalid page number' when v = 3 then 'not a PNG or JPEG image' end
                when 'redact' then case when n < 1 or v = 2 and n < 4 then 'Invalid page number' end
                when 'redact-multiple' then case when v in (2, 3) then '{overlays.MALFORMED_BOXES}' end end as why,
            case v when 0 then '../x.pdf' when 1 then 'file' || d || '.pdf' when 2 then 'x.exe' when 3 then '' end as filename from f),
        h as (select *, case when operation = 'nothing' then 500 when files and not none and (greatest(coalesce(l1, 0), coalesce(l2, 0), coalesce(l1, 0) + coalesce(l2, 0)) > {LIMIT}) then 413
            when files and (none or operation = 'add-signature' and v = 0) then 500 when missing is not null then 401
            when operation = 'watermark' and v = 3 or operation = 'add-text' and v = 3 or operation = 'redact' and v = 4 or operation = 'add-signature' and v = 4 then 500 when bad is not null then 402
            when not files and (v <> 1 or filename not in (select 'file' || page_id || '.pdf' from pages where page_id % 2 = 0)) then 403 when files and coalesce(unread, why) is not null then 404 else 200 end as s from g)
        select job_id, operation, cast(case when s between 401 and 404 then 400 else s end as integer) as status, s = 200 as success,
            case s when 500 then 'An unexpected error occurred while processing your request. Please try again.' when 413 then 'File size exceeds maximum allowed size of 100MB. Please upload a smaller file.'
                when 401 then 'Missing required parameter: ' || missing when 402 then 'Invalid input: ' || bad when 404 then failed || ': ' || coalesce(unread, why)
                when 403 then case v when 0 then 'Invalid filename: path separators are not allowed' when 1 then 'File not found: ' || filename when 2 then 'Invalid filename: only .pdf, .md, or .docx extensions are allowed' else 'Filename cannot be null or empty' end
                else case operation when 'merge' then 'PDFs merged successfully' when 'split' then 'PDF split into ' || (case v when 0 then n when 1 then (n >= 1)::int + (n >= 2)::int + (n >= 3)::int else 0 end) || ' documents'
                    when 'extract' then 'Pages extracted successfully' when 'remove' then 'Pages removed successfully' when 'watermark' then 'Watermark added successfully' when 'add-text' then 'Text added successfully'
                    when 'add-signature' then 'Signature added successfully' when 'redact' then 'Content redacted successfully' when 'redact-multiple' then 'Content redacted successfully'
                    when 'convert/markdown' then 'PDF converted to Markdown' when 'convert/docx' then 'PDF converted to DOCX' when 'info' then 'Pages: ' || n else 'OK' end end as message,
            case when s <> 200 or operation = 'info' then '' when operation = 'download' then filename
                when operation = 'split' then coalesce(case v when 0 then array_to_string(list_transform(range(1, n + 1), lambda k: 'doc' || d || '_split_page' || k || '_' || {_HEX.format("job_id || ':page:' || k")} || '.pdf'), ',')
                    when 1 then array_to_string(list_transform(list_filter([1, 2, 4], lambda k: case k when 1 then n >= 1 when 2 then n >= 2 else n >= 3 end), lambda k: 'doc' || d || '_split_part' || k || '_' || {_HEX.format("job_id || ':part:' || k")} || '.pdf'), ',') end, '')
                else 'doc' || d || '_' || case operation when 'merge' then 'merged' when 'extract' then 'extracted' when 'remove' then 'removed' when 'watermark' then 'watermarked' when 'add-text' then 'text_added' when 'add-signature' then 'signed'
                    when 'redact' then 'redacted' when 'redact-multiple' then 'redacted' when 'convert/markdown' then 'markdown' else 'docx' end || '_' || {_HEX.format("job_id::varchar")}
                    || case operation when 'convert/markdown' then '.md' when 'convert/docx' then '.docx' else '.pdf' end end as outputs from h""",
    "request_limits": """with f as (select page_id % 40 as job_id, octet_length(encode(html)) * (page_id % 40) as length from pages),
        j as (select job_id, count(*) as n_files, cast(sum(length) as bigint) as n_bytes, max(length) > 100000 or sum(length) > 200000 as over from f group by job_id)
        select job_id, n_files, n_bytes, case when over then 413 else 200 end as status, not over as success, case when over then 'File size exceeds maximum allowed size of 100MB. Please upload a smaller file.' else 'OK' end as message from j""",
    "files_within_limits": """with f as (select page_id % 40 as job_id, page_id as pos, cast(octet_length(encode(html)) * (page_id % 40) as bigint) as length from pages)
        select job_id, pos, length from f where job_id in (select job_id from f group by job_id having max(length) <= 100000 and sum(length) <= 200000)""",
    "split_names": f"select page_id, case when {_STEM} = '' then 'split' else {_STEM} || '_split' end || '_part' || (page_id % 3 + 1) || '_' || {_PART_NAME} || '.pdf' as name, 'split_page' || (page_id % 3 + 1) || '_' || {_HEX.format("page_id || ':page:' || (page_id % 3 + 1)")} || '.pdf' as page_name from pages",
    "name_clashes": f"select page_id % 5 as job_id, 'plan_split_part' || (page_id % 3 + 1) || '_' || {_PART_NAME} || '.pdf' as name, count(*) as n_writers from pages group by 1, 2 having count(*) > 1",
    "last_writers": f"""select arg_max(page_id % 5, (page_id % 5, page_id)) as job_id, arg_max(page_id, (page_id % 5, page_id)) as pos, 'plan_split_part' || (page_id % 3 + 1) || '_' || {_PART_NAME} || '.pdf' as name, count(*) as n_writers
        from pages group by 3""",
    "stamp_status": f"""select doc_id, not bad and not odd as success, case when bad then '{results.FAILED['stamp']}: {overlays.BAD_SHADE}' when odd then '{results.FAILED['stamp']}: U+4E2D is not available in the font HELVETICA_BOLD' else '{results.DONE['stamp']}' end as message
        from (select distinct conv_id as doc_id, not conv_id % 16 between 2 and 12 as bad, conv_id % 5 = 0 as odd from conversations)""",
    "texts_status": f"""select doc_id, cause is null as success, coalesce('{results.FAILED['text']}: ' || cause, '{results.DONE['text']}') as message from (select doc_id, case when n < 4 then 'Invalid page number'
        when doc_id % 3 = 0 then 'U+000A is not available in the font HELVETICA' when doc_id % 4 = 0 then 'U+006F is not available in the font SYMBOL' end as cause from {COUNTS})""",
    "lacking_characters": rf"""select doc_id, case when c <> '' then 'U+' || printf('%04X', unicode(c)) || ' is not available in the font COURIER' end as cause
        from (select doc_id, regexp_extract(replace(text, chr(10), ' '), '[^\x{{20}}-\x{{7e}}\x{{a0}}-\x{{ff}}{drawing.MORE_CHARACTERS}]', 0) as c from documents)""",
    "jpeg_sizes": "select event_id, cast(event_id % 977 + 1 as integer) as width, cast(event_id % 613 + 1 as integer) as height from events",
    "raised_lines": """select conv_id as doc_id, turn + 1 as page_no, array_to_string(list_transform(range(0, (len(string_split(text, ' ')) + 4) // 5), lambda k: array_to_string(string_split(text, ' ')[5 * k + 1 : 5 * k + 5], ' ')), chr(10)) as text from conversations""",
    "committed_files": "select 'file' || page_id || ['.pdf', '.md', '.txt'][page_id % 3 + 1] as name, cast(octet_length(encode(html)) as bigint) as length, sha256(html) as sha256 from pages where html <> ''",
    "downloads": f"""with f as (select page_id, 'file' || page_id || ['.pdf', '.md', '.txt'][page_id % 3 + 1] as name, cast(octet_length(encode(html)) as bigint) as length from pages),
        a as (select *, case when page_id % 7 = 0 then '../' || name else name end as asked, case when page_id % 7 = 0 then '{names.SEPARATOR}' when page_id % 3 = 2 then '{names.EXTENSION}' when page_id % 4 = 0 or length = 0 then 'File not found: ' || name else 'OK' end as verdict from f)
        select asked as name, verdict, case when verdict = 'OK' then length end as length from a""",
}
