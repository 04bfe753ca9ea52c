"""Flows of lines and images made from ``documents`` by integer arithmetic, the same in Spark and in DuckDB.

A line of text is a line of the flow; page, position, font and kind come from doc_id and the line's number i. Some lines
are chapter lines, some are blank, some stand apart from the line before, and some are followed by an image.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def document_lines(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))


def flow_rows(documents: DataFrame) -> DataFrame:
    """A row for each line with all that comes from it: the line of the flow, and its image where ``pictured``.

    A document without text has one row, whose ``i`` is null.
    """
    lines = documents.select("doc_id", F.posexplode_outer(F.split("text", "\n")).alias("i", "line"))
    return lines.selectExpr(
        "doc_id",
        "i",
        "cast(floor(i / 40) as int) + 1 as page_num",
        "60D + 19.5D * (i % 40) + case when (doc_id * 3 + i) % 8 = 5 then 12D else 0D end as y",
        "case when (doc_id + i) % 19 = 7 then concat(element_at(array('Chapter ', 'Capítulo ', 'PARTE ', 'part '), cast((doc_id + i) % 4 as int) + 1), cast(i + 1 as string))"
        " when (doc_id + i) % 31 = 11 then '   ' else line end as text",
        "case when length(line) < 60 and (doc_id * 31 + i * 17) % 23 = 0 then 20D when (doc_id + i * 7) % 29 = 0 then 12D else 15D end as font_size",
        "case when (doc_id * 13 + i * 5) % 7 = 0 then 0.155D when (doc_id + i) % 37 = 0 then 0.62D else 0.126D end as x_start",
        "coalesce((doc_id * 7 + i) % 11 = 0, false) as pictured",
        "60D + 19.5D * (i % 40) + case when i % 3 = 0 then 0D else 9D end as image_y",
        "concat('img_', cast((doc_id * 3 + i) % 9 as string), '_0.', case when (doc_id + i) % 3 = 0 then 'png' else 'jpg' end) as filename",
        "case when (doc_id + i) % 3 = 0 then 'image/png' else 'image/jpeg' end as mime",
        "cast(100 + (doc_id * 37 + i * 53) % 1500 as int) as width",
        "cast(100 + (doc_id * 91 + i * 29) % 2000 as int) as height",
    )


_LINE = "named_struct('page_num', page_num, 'arrival_seq', 2 * i, 'y', y, 'is_image', 0, 'text', text, 'font_size', font_size, 'x_start', x_start, 'image_idx', cast(null as int))"
_SHOWN = "named_struct('page_num', page_num, 'arrival_seq', 2 * i + 1, 'y', image_y, 'is_image', 1, 'text', cast(null as string), 'font_size', cast(null as double), 'x_start', cast(null as double), 'image_idx', i)"


def flow_events(rows: DataFrame) -> DataFrame:
    """The events of ``flow_rows``; a row without an event (all of it null) for documents that have none."""
    return rows.selectExpr("doc_id", f"inline_outer(case when pictured then array({_LINE}, {_SHOWN}) when i is not null then array({_LINE}) end)")


def flow_profile_rows(rows: DataFrame) -> DataFrame:
    """What ``operators.layout.profile_rows`` makes of the events and images of ``flow_rows``, without taking them apart."""
    return rows.select(
        "doc_id", "page_num",
        F.expr("case when i is not null then named_struct('page_num', page_num, 'y', y, 'arrival_seq', 2 * i, 'blank', regexp_replace(text, '(?U)^\\\\s+|\\\\s+$', '') = '', 'font_size', font_size, 'x_start', x_start) end").alias("line"),
        F.expr("case when pictured then named_struct('page_num', page_num, 'y', image_y, 'arrival_seq', 2 * i + 1, 'image_idx', i) end").alias("shown"),
        F.expr("case when pictured then named_struct('key', i, 'value', named_struct('filename', filename, 'mime', mime, 'width', width, 'height', height)) end").alias("entry"),
    )


def flow_lines(documents: DataFrame) -> DataFrame:
    return flow_rows(documents).where("i is not null").selectExpr("doc_id", f"inline(array({_LINE}))")


def image_assets(documents: DataFrame) -> DataFrame:
    """Images; every third stands at the height of its line (a tie in y)."""
    pictured = flow_rows(documents).where("pictured")
    return pictured.selectExpr("doc_id", "i as image_idx", "filename", "mime", "width", "height", "cast(concat('image ', cast(doc_id as string), ' ', cast(i as string)) as binary) as bytes")


def word_glyphs(documents: DataFrame) -> DataFrame:
    """Words as glyphs on pages of 40 lines of 12 words."""
    words = documents.select("doc_id", F.posexplode(F.split("text", " ")).alias("k", "w"))
    return words.selectExpr(
        "doc_id",
        "cast(floor(k / 480) as int) + 1 as page_num",
        "k",
        "50D + 40D * (k % 12) as x",
        "60D + 14D * floor(k % 480 / 12) + case when (doc_id + k) % 17 = 0 then 3D else 0D end as y",
        "3.5D as width",
        "case when (doc_id + k) % 23 = 0 then 12D else 10D end as font_size",
        "concat(w, ' ') as ch",
        "k % 5 <> 3 as word_start",
        "600D as page_width",
    )


def line_nodes(documents: DataFrame) -> DataFrame:
    """Lines as nodes of trees, some with a value; some ways lead to no node, some into a cycle."""
    return document_lines(documents).selectExpr(
        "doc_id",
        "i as id",
        "case when i = 0 or (doc_id + i) % 41 = 0 then null when (doc_id * 5 + i) % 23 = 3 then i + 2 else i - 1 - (doc_id + 3 * i) % least(i, 4) end as parent",
        "case when length(line) % 31 = 7 then length(line) end as value",
    )


def line_operators(documents: DataFrame) -> DataFrame:
    """Lines as operators of a content stream: matrices turn by right angles and shift by whole numbers."""
    return document_lines(documents).selectExpr(
        "doc_id",
        "cast(i as bigint) as k",
        "element_at(array('q', 'cm', 'Do', 'Q', 'cm', 'q', 'BT', 'Do', 'Q', 'cm', 'Do'), cast((doc_id * 7 + i * 3 + length(line)) % 11 as int) + 1) as op",
        "element_at(array(1D, 0D, -1D, 0D), cast(length(line) % 4 as int) + 1) as a",
        "element_at(array(0D, 1D, 0D, -1D), cast(length(line) % 4 as int) + 1) as b",
        "element_at(array(0D, -1D, 0D, 1D), cast(length(line) % 4 as int) + 1) as c",
        "element_at(array(1D, 0D, 1D, 0D), cast(length(line) % 4 as int) + 1) as d",
        "cast(i * 13 % 40 - 20 as double) as e",
        "cast(length(line) % 50 as double) as f",
    )


#: The same in DuckDB, as common table expressions; each may use those before it.
CTES = {
    "q": "select doc_id, unnest(range(len(string_split(text, chr(10)))))::int as i, unnest(string_split(text, chr(10))) as line from documents where text is not null",
    "lines": """select doc_id, (i // 40)::int + 1 as page_num, 2 * i as arrival_seq,
  60::double + 19.5::double * (i % 40) + case when (doc_id * 3 + i) % 8 = 5 then 12::double else 0::double end as y, 0 as is_image,
  case when (doc_id + i) % 19 = 7 then ['Chapter ', 'Capítulo ', 'PARTE ', 'part '][((doc_id + i) % 4)::int + 1] || (i + 1)::varchar when (doc_id + i) % 31 = 11 then '   ' else line end as text,
  case when length(line) < 60 and (doc_id * 31 + i * 17) % 23 = 0 then 20::double when (doc_id + i * 7) % 29 = 0 then 12::double else 15::double end as font_size,
  case when (doc_id * 13 + i * 5) % 7 = 0 then 0.155::double when (doc_id + i) % 37 = 0 then 0.62::double else 0.126::double end as x_start, null::int as image_idx from q""",
    "shown": """select doc_id, (i // 40)::int + 1 as page_num, 2 * i + 1 as arrival_seq, 60::double + 19.5::double * (i % 40) + case when i % 3 = 0 then 0::double else 9::double end as y, 1 as is_image,
  null::varchar as text, null::double as font_size, null::double as x_start, i as image_idx from q where (doc_id * 7 + i) % 11 = 0""",
    "events": """select *, row_number() over (partition by doc_id order by page_num, y, is_image, arrival_seq)::int as event_seq from (select * from lines union all select * from shown)""",
    "images": """select doc_id, i as image_idx, 'img_' || ((doc_id * 3 + i) % 9)::varchar || '_0.' || case when (doc_id + i) % 3 = 0 then 'png' else 'jpg' end as filename,
  case when (doc_id + i) % 3 = 0 then 'image/png' else 'image/jpeg' end as mime, (100 + (doc_id * 37 + i * 53) % 1500)::int as width, (100 + (doc_id * 91 + i * 29) % 2000)::int as height,
  ('image ' || doc_id::varchar || ' ' || i::varchar) as bytes from q where (doc_id * 7 + i) % 11 = 0""",
    "docs": "select doc_id from documents",
    "pages_": "select distinct doc_id, page_num from events",
    "texts": r"select * replace (regexp_replace(text, '^\s+|\s+$', '', 'g') as text) from events where is_image = 0 and regexp_replace(text, '^\s+|\s+$', '', 'g') <> ''",
    "fonts": """select doc_id, greatest(font_size, 2.2250738585072014e-308::double) as baseline_font from (select doc_id, font_size, row_number() over (partition by doc_id order by font_size) k, count(*) over (partition by doc_id) n from texts)
  where k = round((n - 1) * 0.5::double)::int + 1""",
    "margins": """select doc_id, x_start as left_margin from (select doc_id, x_start, row_number() over (partition by doc_id order by x_start) k, count(*) over (partition by doc_id) n from texts)
  where k = round((n - 1) * 0.1::double)::int + 1""",
    "gaps": "select * from (select doc_id, page_num, event_seq, y - lag(y) over (partition by doc_id, page_num order by event_seq) as gap from texts) where gap > 0",
    "linegaps": """select doc_id, greatest(gap, 2.2250738585072014e-308::double) as line_gap from (select doc_id, gap, row_number() over (partition by doc_id order by gap) k, count(*) over (partition by doc_id) n from gaps)
  where k = round((n - 1) * 0.5::double)::int + 1""",
    "metrics": """select doc_id, coalesce(baseline_font, 1::double) as baseline_font, coalesce(left_margin, 0::double) as left_margin, coalesce(line_gap, baseline_font, 1::double) as line_gap
  from docs left join fonts using (doc_id) left join margins using (doc_id) left join linegaps using (doc_id)""",
    "bases": """select doc_id, coalesce(font_size, 1::double) as baseline from docs left join (select doc_id, font_size from (select doc_id, font_size, row_number() over (partition by doc_id order by font_size) k,
  count(*) over (partition by doc_id) n from lines) where k - 1 = n // 2) using (doc_id)""",
    "heads": r"""select *, coalesce(is_image = 0 and regexp_matches(t, '[\p{L}\p{N}]') and (regexp_matches(t, '(?i)^\s*(cap[ií]tulo|chapter|parte|part)\s+\d+')
  or (baseline > 0 and font_size >= baseline * 1.25::double and length(t) < 80)), false) as is_heading from (select *, regexp_replace(text, '^\s+|\s+$', '', 'g') as t from events join bases using (doc_id))""",
    "marked": """select *, sum(s) over (partition by doc_id order by event_seq rows unbounded preceding)::bigint as chapter_id from (select *,
  (is_heading and not coalesce(lag(is_heading) over (partition by doc_id order by event_seq), false))::int as s from heads)""",
    "found": "select doc_id, chapter_id, string_agg(t, ' ' order by event_seq) filter (is_heading) as title, count(*) filter (not is_heading) as n_events from marked group by all",
    "chapters": """select doc_id, coalesce(chapter_id, 0)::bigint as chapter_id, row_number() over (partition by doc_id order by chapter_id)::int as chapter_ord, coalesce(title, 'Introdução') as title, coalesce(n_events, 0)::bigint as n_events
  from (select *, max(coalesce(n_events, 0)) over (partition by doc_id) as m, max(chapter_id) over (partition by doc_id) as l from docs left join found using (doc_id))
  where n_events > 0 or (m = 0 and chapter_id is not distinct from l)""",
    "best": """select *, width >= 300 and height >= 400 as fits, width >= 625 and height >= 1000 as sharp from (select doc_id, page_num, page_ord, image_idx, filename, mime, width, height,
  row_number() over (partition by doc_id, page_ord order by width::bigint * height desc, event_seq desc) k from events join (select *, row_number() over (partition by doc_id order by page_num) as page_ord from pages_) using (doc_id, page_num)
  join images using (doc_id, image_idx) where is_image = 1 and page_ord <= 2) where k = 1""",
    "covers": """select doc_id, case when image_idx is null then 'drawn' else 'detected' end as source, case when mime is null then 'cover.svg' when mime = 'image/jpeg' then 'cover.jpg' else 'cover.png' end as filename,
  coalesce(mime, 'image/svg+xml') as mime, coalesce(width, 1600) as width, coalesce(height, 2560) as height, image_idx as consumed_image
  from docs left join (select *, row_number() over (partition by doc_id order by page_ord) r from best where fits) b using (doc_id) where r is null or r = 1""",
    "body": "select m.* from marked m join covers c using (doc_id) where not is_heading and not (is_image = 1 and image_idx is not distinct from consumed_image)",
    "kinds": r"""select *, case when is_image = 1 then 'image' when regexp_matches(t, '[\p{L}\p{N}]') and font_size >= baseline_font * 1.10::double and length(t) < 80 then 'heading'
  when after_image and font_size <= baseline_font * 0.92::double then 'caption' when x_start > 0.45::double and length(t) < 60 then 'right' else 'paragraph' end as kind,
  coalesce(x_start > left_margin + 0.012::double, false) as indented, coalesce(y - previous_y > 0 and y - previous_y > line_gap * 1.35::double, false) as gapped
  from (select *, case when not after_image then lag(y) over w end as previous_y from (select *, coalesce(lag(is_image) over w = 1, false) as after_image from body where is_image = 1 or t <> '' window w as (partition by doc_id, chapter_id order by event_seq))
  window w as (partition by doc_id, chapter_id order by event_seq)) join metrics using (doc_id)""",
    "blocks": """select doc_id, chapter_id, block_ord, max(kind) as kind, string_agg(t, ' ' order by event_seq) as text, max(image_idx) as image_idx from (select *, sum(b) over (partition by doc_id, chapter_id order by event_seq rows unbounded preceding)::bigint as block_ord
  from (select *, (kind = 'image' or after_image or lag(kind) over w is null or kind <> lag(kind) over w or (kind = 'paragraph' and (indented or gapped)))::int as b from kinds window w as (partition by doc_id, chapter_id order by event_seq))) group by doc_id, chapter_id, block_ord""",
    "html": """select * from (select b.*, filename, case kind when 'heading' then '<h2>' || e || '</h2>' || chr(10) when 'paragraph' then '<p>' || e || '</p>' || chr(10) when 'caption' then '<p class="legenda">' || e || '</p>' || chr(10)
  when 'right' then '<p class="direita">' || e || '</p>' || chr(10) else '<img src="images/' || filename || '" alt=""/>' || chr(10) end as html
  from (select *, replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') as e from blocks) b left join (select doc_id, image_idx, filename from images) using (doc_id, image_idx)) where html is not null""",
    "bodies": "select c.*, coalesce(body, '') as body from chapters c left join (select doc_id, chapter_id, string_agg(html, '' order by block_ord) as body from html group by all) using (doc_id, chapter_id)",
    "kept": r"select *, row_number() over (partition by doc_id order by chapter_ord)::int as out_ord from bodies where regexp_replace(body, '^\s+|\s+$', '', 'g') <> ''",
}


def with_ctes(select: str, others: dict[str, str] | None = None) -> str:
    """A DuckDB query over the expressions that it needs, some of which may be ``others``."""
    import re

    needed: list[str] = []
    ctes = CTES | (others or {})

    def visit(sql: str) -> None:
        for name in ctes:
            if name not in needed and re.search(rf"(?:from|join)\s+\(?\s*{name}\b", sql):
                visit(ctes[name])
                needed.append(name)

    visit(select)
    return (f"with {', '.join(f'{n} as ({ctes[n]})' for n in needed)} " if needed else "") + select
