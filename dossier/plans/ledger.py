"""Queries on redactions read from glyphs and rectangles, and on the ledger drawn from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from dossier.functions import colours
from dossier.operators import codes, ledger, redaction
from dossier.sources.corpus import WORDS_SQL, redactions, table, words

PAGE = ["doc_id", "page"]
_COLOURS = [[0.0], [255.0, 255.0, 255.0], [0.0, 0.0, 0.0, 1.0], [0.5, 0.5, 0.5], None, [0.1, 0.2]]


def _colour(k):
    shapes = F.array(*(F.array(*map(F.lit, c)) if c else F.lit(None).cast("array<double>") for c in _COLOURS))
    return colours.rgb(F.element_at(shapes, (k % len(_COLOURS) + 1).cast("int")))


def _shapes(spark, sf_dir):
    """Every word as one glyph, and rectangles painted before or after what they cover, in all kinds of colours."""
    w = words(table(spark, sf_dir, "documents"))
    glyphs = w.select(*PAGE, F.col("pos").alias("gid"), F.when(F.col("pos") % 17 != 0, F.col("pos") * 10).alias("seq"), "text", "x", "y", "w", "h", _colour(F.col("pos")).alias("colour"), (F.col("pos") % 5 == 0).alias("invisible"))
    rects = redactions(w).select(*PAGE, "rid", F.when(F.col("rid") % 19 != 0, F.col("rid") * 10 + (F.col("rid") % 3 - 1)).alias("seq"), "x", "y", "w", "h", F.lit(612.0).alias("page_w"), F.lit(792.0).alias("page_h"), (F.col("rid") % 11 != 0).alias("filled"), F.when(F.col("rid") % 7 == 0, 0.5).otherwise(1.0).alias("opacity"), _colour(F.col("rid") + 2).alias("colour"))
    return w, glyphs, rects


def q_colours(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", _colour(F.col("p_partkey")).alias("a"), _colour(F.col("p_size")).alias("b"))
    return p.select("p_partkey", F.round("a.r", 6).alias("r"), F.round("a.g", 6).alias("g"), F.round("a.b", 6).alias("b"), colours.same(F.col("a"), F.col("b")).alias("same"), colours.dark(F.col("a")).alias("dark"))


def q_redaction_candidates(spark, sf_dir):
    return redaction.candidates(_shapes(spark, sf_dir)[2]).select(*PAGE, "rid")


def q_hidden_glyphs(spark, sf_dir):
    _, glyphs, rects = _shapes(spark, sf_dir)
    return redaction.hidden(glyphs, rects).select(*PAGE, "gid", F.col("b_rid").alias("rid"))


def q_wiped_text(spark, sf_dir):
    """What each rectangle hides, in reading order."""
    _, glyphs, rects = _shapes(spark, sf_dir)
    return redaction.wiped(redaction.hidden(glyphs, rects)).select(*PAGE, "rid", "n", "text")


def q_leaks(spark, sf_dir):
    _, glyphs, rects = _shapes(spark, sf_dir)
    return redaction.findings(redaction.wiped(redaction.hidden(glyphs, rects)))


def q_redaction_ledger(spark, sf_dir):
    """Rectangles that count as redactions, with blocks of the picture beside them."""
    w, glyphs, rects = _shapes(spark, sf_dir)
    raster = w.where((F.col("doc_id") + F.col("pos")) % 89 == 0).select(*PAGE, (F.col("pos") + 1_000_000).alias("rid"), "x", "y", "w", "h")
    return redaction.ledger(rects, redaction.wiped(redaction.hidden(glyphs, rects)), raster).groupBy(*PAGE, "kind").agg(F.count("*").alias("n"), F.round(F.sum(F.col("w") * F.col("h")), 8).alias("area"))


def q_overprinted(spark, sf_dir):
    """Invisible glyphs under others; every fifth glyph is printed again, a little beside itself."""
    _, glyphs, _ = _shapes(spark, sf_dir)
    again = glyphs.where("gid % 10 = 0").withColumns({"x": F.col("x") + F.col("w") * (F.col("gid") % 3) * 0.3, "gid": F.col("gid") + 1_000_000, "invisible": F.lit(False)})
    return redaction.overprinted(glyphs.unionByName(again))


def q_unseen_words(spark, sf_dir):
    w, glyphs, _ = _shapes(spark, sf_dir)
    return redaction.unseen_words(w.withColumn("ink", F.when(F.col("pos") % 3 != 0, (F.col("pos") % 4) * 0.001)), glyphs)


def q_code_boxes(spark, sf_dir):
    """Which box each code on a page explains; every 41st word is a code."""
    w = words(table(spark, sf_dir, "documents"))
    hits = w.where("(doc_id + pos) % 41 = 0").select(*PAGE, F.col("pos").alias("hid"), "x", "y", "w", "h")
    return codes.associated(hits, redactions(w))


def q_code_labels(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.element_at(F.array(*map(F.lit, ("b(7)", "b(7)(C)", "s.40(2)", "b(9)"))), (F.col("p_partkey") % 4 + 1).cast("int")).alias("code"))
    return codes.labelled(p, spark.createDataFrame([("b(7)", "law"), ("b(7)(C)", "privacy"), ("s.40", "person")], "code string, label string"))


def _marks(spark, sf_dir):
    w = words(table(spark, sf_dir, "documents"))
    marks = redactions(w).withColumn("codes", F.when(F.col("rid") % 3 == 0, F.array(F.concat(F.lit("b("), (F.col("rid") % 9 + 1).cast("string"), F.lit(")")))).otherwise(F.array().cast("array<string>")))
    pages = w.select(*PAGE).distinct().withColumns({"aspect": F.when((F.col("doc_id") + F.col("page")) % 7 == 0, 0.7).otherwise(1.294), "codes": F.when(F.col("page") % 2 == 0, F.array(F.lit("b(6)"))).otherwise(F.array(F.lit("b(1)"), F.lit("b(2)")))})
    return ledger.cells(marks.withColumn("x", F.col("x") - 0.01), pages), pages


def q_ledger_cells(spark, sf_dir):
    return _marks(spark, sf_dir)[0].select(*PAGE, "rid", F.round("x", 6).alias("x"), F.round("w", 6).alias("w"), "code", "inherited", F.round("share", 9).alias("share"))


def q_ledger_selected(spark, sf_dir):
    """The largest marks of the pages with most withheld."""
    return ledger.selected(_marks(spark, sf_dir)[0], 200, 600).select(*PAGE, "rid")


def q_ledger_left_out(spark, sf_dir):
    drawn = _marks(spark, sf_dir)[0]
    out = ledger.left_out(drawn, ledger.selected(drawn, 200, 600))
    return out.withColumn("area_share", F.round("area_share", 6))


def q_ledger_layout(spark, sf_dir):
    """Where each page that is drawn stands in the field."""
    own = ledger.selected(_marks(spark, sf_dir)[0]).select(*PAGE, "aspect").distinct()
    return ledger.laid_out(ledger.scaled(own)).select(*PAGE, *(F.round(c, 4).alias(c) for c in ("x", "y", "w", "h")), "odd")


def q_ledger_by_size(spark, sf_dir):
    return ledger.by_size(ledger.selected(_marks(spark, sf_dir)[0], 200, 600)).select(*PAGE, "rid", "place")


def q_ledger_packed(spark, sf_dir):
    """Marks packed into rows, in bands by code."""
    drawn = ledger.by_size(ledger.selected(_marks(spark, sf_dir)[0], 200, 600))
    return ledger.packed(drawn.select(F.col("code").alias("band"), "place", F.concat_ws("/", *PAGE, "rid").alias("rid"), (F.col("w") * 120).alias("w"), (F.col("h") * 150).alias("h")))


def q_ledger_by_code(spark, sf_dir):
    rows = ledger.by_code(_marks(spark, sf_dir)[0], [f"b({k})" for k in range(1, 10)])
    return rows.select("code", "n", "inherited", F.round("total", 6).alias("total"), F.round("median", 8).alias("median"), F.round("largest", 8).alias("largest"), "place")


def q_blind_spots(spark, sf_dir):
    drawn, pages = _marks(spark, sf_dir)
    pages = pages.withColumns({"ratio": (F.col("doc_id") % 11) / 10, "dark": F.col("doc_id") % 13 == 0, "rendered": F.col("page") % 4 != 0})
    order = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("series"), F.col("o_orderkey").alias("value"))
    from dossier.operators import series

    return ledger.blind_spots(pages, drawn, series.gaps(order))


_RGB = "(case p when 0 then [0, 0, 0] when 1 then [1, 1, 1] when 2 then [0, 0, 0] when 3 then [0.5, 0.5, 0.5] end)"


def _rgb(k: str) -> str:
    return f"(case ({k}) % 6 when 0 then 0.0 when 1 then 1.0 when 2 then 0.0 when 3 then 0.5 end)::double"


_CAND = "cand as (select *, case when rid % 19 <> 0 then rid * 10 + rid % 3 - 1 end as seq from redactions where rid % 11 <> 0 and rid % 7 <> 0 and w * 612 > 4 and h * 792 > 4 and y * 792 + h * 792 > 43)"
_HIDDEN = f"""{_CAND}, hid as (select w.doc_id, w.page, w.pos as gid, c.rid, w.text, w.x, w.y, w.w, w.h from words w join cand c on w.doc_id = c.doc_id and w.page = c.page and w.line % 34 = c.rid // 12 % 34
    where w.x < c.x + c.w and c.x < w.x + w.w and w.y < c.y + c.h and c.y < w.y + w.h and (least(w.x + w.w, c.x + c.w) - greatest(w.x, c.x)) * (least(w.y + w.h, c.y + c.h) - greatest(w.y, c.y)) / (w.w * w.h) > 0.8
    and (coalesce(case when w.pos % 17 <> 0 then w.pos * 10 end < c.seq, false) or coalesce(abs({_rgb("w.pos")} - {_rgb("c.rid + 2")}) <= 0.05, false))),
  wd as (select *, lag(x + w) over (partition by doc_id, page, rid order by x) as before, list_sort(list(w) over (partition by doc_id, page, rid))[count(*) over (partition by doc_id, page, rid) // 2 + 1] as usual from hid),
  wiped as (select doc_id, page, rid, count(*) as n, trim(string_agg(case when x - before > usual / 4 then ' ' else '' end || text, '' order by x)) as text from wd group by doc_id, page, rid)"""
_REAL = r"length(replace(text, text[1], '')) > 0 and regexp_matches(text, '[\p{L}\p{N}_]') and not regexp_full_match(lower(text), 'name\s+redacted|confidential|privileged|redacted')"
_MARKS = """mk as (select doc_id, page, rid, greatest(0.0::double, x - 0.01) as x, least(1.0::double, x - 0.01 + w) as x2, y, least(1.0::double, y + h) as y2, case when rid % 3 = 0 then 'b(' || (rid % 9 + 1) || ')' end as own from redactions),
  marks as (select doc_id, page, rid, x, y, x2 - x as w, y2 - y as h, (x2 - x) * (y2 - y) as share, case when (doc_id + page) % 7 = 0 then 0.7::double else 1.294::double end as aspect, coalesce(own, case when page % 2 = 0 then 'b(6)' end, '') as code, own is null and page % 2 = 0 as inherited from mk where x2 > x and y2 > y)"""
_CHOSEN = f"""{_MARKS}, top as (select doc_id, page from marks group by doc_id, page order by round(sum(share), 12) desc, doc_id, page limit 200),
  chosen as (select m.* from marks m join top using (doc_id, page) order by round(share, 12) desc, doc_id, page, y, x limit 600)"""

ORACLE = {
    "q_colours": f"select p_partkey, round({_rgb('p_partkey')}, 6) as r, round({_rgb('p_partkey')}, 6) as g, round({_rgb('p_partkey')}, 6) as b, coalesce(abs({_rgb('p_partkey')} - {_rgb('p_size')}) <= 0.05, false) as same, coalesce({_rgb('p_partkey')} <= 70 / 255.0, false) as dark from part",
    "q_redaction_candidates": f"with {WORDS_SQL}, {_CAND} select doc_id, page, rid from cand",
    "q_hidden_glyphs": f"with {WORDS_SQL}, {_HIDDEN} select doc_id, page, gid, rid from hid",
    "q_wiped_text": f"with {WORDS_SQL}, {_HIDDEN} select doc_id, page, rid, n, text from wiped",
    "q_leaks": f"with {WORDS_SQL}, {_HIDDEN} select doc_id, page, rid, text from wiped where {_REAL}",
    "q_redaction_ledger": f"""with {WORDS_SQL}, {_HIDDEN}, led as (select c.* from cand c left join wiped w using (doc_id, page, rid) where w.rid is not null or coalesce({_rgb("c.rid + 2")} <= 70 / 255.0, false)),
      ras as (select doc_id, page, pos, line, x, y, w, h from words where (doc_id + pos) % 89 = 0),
      dup as (select distinct r.doc_id, r.page, r.pos from ras r join led l on r.doc_id = l.doc_id and r.page = l.page where r.x < l.x + l.w and l.x < r.x + r.w and r.y < l.y + l.h and l.y < r.y + r.h and (least(r.x + r.w, l.x + l.w) - greatest(r.x, l.x)) * (least(r.y + r.h, l.y + l.h) - greatest(r.y, l.y)) / (r.w * r.h) > 0.6)
      select doc_id, page, kind, count(*) as n, round(sum(w * h), 8) as area from (select doc_id, page, 'vector' as kind, w, h from led union all select doc_id, page, 'raster', w, h from ras where (doc_id, page, pos) not in (select (doc_id, page, pos) from dup)) group by all""",
    "q_overprinted": f"with {WORDS_SQL} select doc_id, page, pos as gid from words where pos % 10 = 0 and pos % 3 < 2",
    "q_unseen_words": f"with {WORDS_SQL} select doc_id, page, pos from words where pos % 5 = 0 and pos % 3 <> 0 and (pos % 4) * 0.001 < 0.002",
    "q_code_labels": "select p_partkey, (['b(7)', 'b(7)(C)', 's.40(2)', 'b(9)'])[p_partkey % 4 + 1] as code, case p_partkey % 4 when 0 then 'law' when 1 then 'privacy' when 2 then 'person' end as label from part",
    "q_code_boxes": f"""with {WORDS_SQL}, c0 as (select *, y >= 0.9 or y + h <= 0.06 as band from words where (doc_id + pos) % 41 = 0), c as (select *, band and sum(band::int) over (partition by doc_id, page) >= 3 as legend from c0),
      p as (select c.doc_id, c.page, c.pos as hid, r.rid, not c.band and least(c.y + c.h, r.y + r.h) - greatest(c.y, r.y) >= 0.5 * least(c.h, r.h) as line,
        round(sqrt((greatest(0.0, r.x - c.x - c.w, c.x - r.x - r.w) * 612 / 792.0::double) ** 2 + greatest(0.0, r.y - c.y - c.h, c.y - r.y - r.h) ** 2), 9) as gap from c join redactions r on c.doc_id = r.doc_id and c.page = r.page where not c.legend),
      q as (select *, sum(line::int) over (partition by doc_id, page, hid) as n from p where line or gap <= 0.05), b as (select *, row_number() over (partition by doc_id, page, hid order by gap, rid) as k from q where case when n = 1 then line when n > 1 then line and gap <= 0.05 else gap <= 0.05 end)
      select c.doc_id, c.page, c.pos as hid, b.rid from c left join b on b.doc_id = c.doc_id and b.page = c.page and b.hid = c.pos and b.k = 1""",
    "q_ledger_cells": f"with {WORDS_SQL}, {_MARKS} select doc_id, page, rid, round(x, 6) as x, round(w, 6) as w, code, inherited, round(share, 9) as share from marks",
    "q_ledger_selected": f"with {WORDS_SQL}, {_CHOSEN} select doc_id, page, rid from chosen",
    "q_ledger_left_out": f"""with {WORDS_SQL}, {_CHOSEN} select (select count(distinct (doc_id, page)) from marks) - (select count(distinct (doc_id, page)) from chosen) as n_pages_left, (select count(*) from marks) - (select count(*) from chosen) as n_marks_left,
      round((select sum(share) from chosen) / (select sum(share) from marks), 6) as area_share""",
    "q_ledger_layout": f"""with {WORDS_SQL}, {_CHOSEN.replace("limit 200", "limit 1200").replace("limit 600", "limit 8000")}, p as (select distinct doc_id, page, aspect from chosen), s0 as (select count(*) as n, median(aspect) as usual, min(aspect) as widest, max(aspect) as tallest from p),
      s1 as (select *, least(greatest(1.0, ceil(sqrt(n * 1.6)), 5.0), 31.0)::double as cols from s0), s2 as (select *, (1000 - (cols - 1) * 6) / cols as slot_w from s1), s3 as (select *, slot_w * slot_w * greatest(widest, usual / 1.35) as area from s2), s as (select *, least(sqrt(area * tallest), slot_w * usual * 2.2) as slot_h from s3),
      q as (select doc_id, page, cols, slot_w, slot_h, sqrt(area / aspect) as w0, sqrt(area * aspect) as h0, row_number() over (partition by doc_id order by page) - 1 as k from p, s), f as (select *, least(1.0, slot_w / w0, slot_h / h0) as fit from q),
      g as (select *, fit < 0.999 as odd, case when fit < 0.999 then w0 * fit else w0 end as w, case when fit < 0.999 then h0 * fit else h0 end as h from f),
      b as (select doc_id, 24 + ceil(count(*) / any_value(cols)) * any_value(slot_h) + (ceil(count(*) / any_value(cols)) - 1) * 6 + 32 as height from g group by doc_id), t as (select doc_id, coalesce(sum(height) over (order by doc_id rows between unbounded preceding and 1 preceding), 0) + 24 as top from b)
      select doc_id, page, round((k % cols) * (slot_w + 6) + (slot_w - w) / 2, 4) as x, round(top + floor(k / cols) * (slot_h + 6) + (slot_h - h), 4) as y, round(w, 4) as w, round(h, 4) as h, odd from g join t using (doc_id)""",
    "q_ledger_by_size": f"with {WORDS_SQL}, {_CHOSEN} select doc_id, page, rid, row_number() over (order by round(share, 12) desc, doc_id, page, y, rid)::int as place from chosen",
    "q_ledger_by_code": f"""with {WORDS_SQL}, {_MARKS}, c as (select code, count(*) as n, sum(inherited::int)::bigint as inherited, sum(share) as total, median(share) as median, max(share) as largest from marks group by code)
      select code, n, inherited, round(total, 6) as total, round(median, 8) as median, round(largest, 8) as largest, row_number() over (order by round(total, 9) desc, case when code = '' then 10 else code[3]::int end, code)::int as place from c""",
    "q_blind_spots": f"""with {WORDS_SQL}, {_MARKS}, p as (select distinct doc_id, page from words), g as (select value, lead(value) over (partition by series order by value) as next from (select distinct o_custkey as series, o_orderkey as value from orders))
      select (select sum((doc_id % 11 >= 9)::int)::bigint from p) as n_full, (select sum((doc_id % 13 = 0)::int)::bigint from p) as n_dark, (select sum((page % 4 = 0)::int)::bigint from p) as n_unrendered, (select sum((code = '')::int)::bigint from marks) as n_uncoded,
        (select count(*) from g where next > value + 1) as n_gaps, (select sum(next - value - 1)::bigint from g where next > value + 1) as n_missing""",
}
QUERIES = {k: v for k, v in globals().items() if k.startswith("q_")}
