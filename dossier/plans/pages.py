"""Queries on boxes, pages, ledgers and codes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from dossier.functions import geometry as g
from dossier.functions import markup
from dossier.operators import codes, spatial
from dossier.sources.corpus import WORDS_SQL, redactions, table, words

PAGE = ["doc_id", "page"]


def _both(spark, sf_dir):
    w = words(table(spark, sf_dir, "documents"))
    return w, redactions(w)


def q_drop_hidden(spark, sf_dir):
    w, r = _both(spark, sf_dir)
    return spatial.visible(w, r).groupBy("doc_id", "page").agg(F.count("*").alias("n_visible"), F.sum("pos").alias("pos_sum"))


def q_hidden_text(spark, sf_dir):
    w, r = _both(spark, sf_dir)
    return spatial.covered(w, r).select("doc_id", "page", F.col("b_rid").alias("rid"), "pos")


def q_words_in_regions(spark, sf_dir):
    w, r = _both(spark, sf_dir)
    return spatial.in_regions(w, r).select("doc_id", "page", "pos", F.round("inside", 6).alias("inside"))


def q_area_union(spark, sf_dir):
    _, r = _both(spark, sf_dir)
    return spatial.union_cells(r)


def q_redaction_ratio(spark, sf_dir):
    w, r = _both(spark, sf_dir)
    ink = spatial.union_cells(w.select("doc_id", "page", "x", "y", "w", "h").unionByName(r.drop("rid"))).withColumnRenamed("cells", "ink_cells")
    return ink.join(spatial.union_cells(r), PAGE, "left").select("doc_id", "page", "ink_cells", F.coalesce("cells", F.lit(0)).alias("cells"), F.round(F.coalesce("cells", F.lit(0)) / F.col("ink_cells"), 6).alias("ratio"))


def q_layout_profile(spark, sf_dir):
    return spatial.layout(words(table(spark, sf_dir, "documents"))).select("doc_id", "page", "cell", F.round("share", 6).alias("share"))


def q_locate(spark, sf_dir):
    """Where on the page each stretch of 100 characters stands: the union of the boxes of all tokens that it touches."""
    w = words(table(spark, sf_dir, "documents"))
    start = F.coalesce(F.sum(F.length("text") + 1).over(Window.partitionBy(*PAGE).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    stretch = F.explode(F.sequence(F.floor(F.col("start") / 100), F.floor((F.col("start") + F.length("text") - 1) / 100)))
    return w.withColumn("start", start).withColumn("stretch", stretch).groupBy("doc_id", "page", "stretch").agg(F.round(F.min("x"), 6).alias("x1"), F.round(F.min("y"), 6).alias("y1"), F.round(F.max(F.col("x") + F.col("w")), 6).alias("x2"), F.round(F.max(F.col("y") + F.col("h")), 6).alias("y2"))


def _neighbours(spark, sf_dir):
    _, r = _both(spark, sf_dir)
    order = Window.partitionBy(*PAGE).orderBy("rid")
    return r.select("*", *[F.lead(c).over(order).alias(f"b_{c}") for c in ("x", "y", "w", "h")]).where("b_x is not null")


def q_box_ops(spark, sf_dir):
    rows = _neighbours(spark, sf_dir).withColumns({"b_x": F.col("x") + F.col("b_w") / 4, "b_y": F.col("y") + 0.005})
    a, b = g.box(), g.box("b_")
    return rows.select("doc_id", "page", "rid", F.round(g.overlap(a, b), 6).alias("shared"), F.round(g.overlap_ratio(a, b), 6).alias("ratio"), F.round(g.iou(a, b), 6).alias("iou"), F.round(g.shift(a, b), 6).alias("shift"))


def q_subtract(spark, sf_dir):
    rows = _neighbours(spark, sf_dir).withColumns({"b_x": F.col("x") + F.col("b_w") / 4, "b_y": F.col("y") + 0.005})
    pieces = rows.select("doc_id", "page", "rid", F.explode(g.remainder(g.box(), g.box("b_"))).alias("p"))
    return pieces.groupBy("doc_id", "page", "rid").agg(F.count("*").alias("n_pieces"), F.round(F.sum((F.col("p.x2") - F.col("p.x1")) * (F.col("p.y2") - F.col("p.y1"))), 6).alias("left_area"))


def _states(spark, sf_dir):
    w, r = _both(spark, sf_dir)
    n = r.groupBy(*PAGE).agg(F.count("*").alias("n_boxes"))
    state = F.when(F.col("n_boxes") >= 6, "full").when(F.col("n_boxes") >= 4, "part").when(F.col("n_boxes") >= 1, "some").otherwise("plain")
    return w.groupBy(*PAGE).agg(F.count("*").alias("n_words")).join(n, PAGE, "left").withColumn("n_boxes", F.coalesce("n_boxes", F.lit(0))).withColumn("state", state)


def q_page_states(spark, sf_dir):
    return _states(spark, sf_dir).groupBy("state").agg(F.count("*").alias("n_pages"), F.sum("n_boxes").alias("n_boxes"))


def q_ribbon_rle(spark, sf_dir):
    order = Window.partitionBy("doc_id").orderBy("page")
    runs = _states(spark, sf_dir).withColumn("new", F.coalesce((F.lag("state").over(order) != F.col("state")).cast("int"), F.lit(1)))
    runs = runs.withColumn("run", F.sum("new").over(order))
    return runs.groupBy("doc_id", "run").agg(F.min("state").alias("state"), F.min("page").alias("first_page"), F.count("*").alias("n_pages"))


def q_worst_pages(spark, sf_dir):
    return _states(spark, sf_dir).orderBy(F.desc("n_boxes"), "doc_id", "page").limit(12).select("doc_id", "page", "n_boxes")


def q_negative_topk(spark, sf_dir):
    """The 500 largest boxes, and what the selection leaves out."""
    _, r = _both(spark, sf_dir)
    r = r.withColumn("area", F.round(F.col("w") * F.col("h"), 6))
    top = r.orderBy(F.desc("area"), "doc_id", "page", "rid").limit(500).select(F.lit("kept").alias("part"), "doc_id", "page", "rid", F.lit(1).cast("long").alias("n"))
    total = r.agg(F.count("*").alias("n")).select(F.lit("left out").alias("part"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("int").alias("page"), F.lit(None).cast("int").alias("rid"), F.greatest(F.col("n") - 500, F.lit(0)).cast("long").alias("n"))
    return top.unionByName(total)


def q_summarise(spark, sf_dir):
    pages = _states(spark, sf_dir)
    return pages.agg(F.count_distinct("doc_id").alias("n_documents"), F.count("*").alias("n_pages"), F.sum("n_words").alias("n_words"), F.sum("n_boxes").alias("n_boxes"), F.sum((F.col("n_boxes") > 0).cast("long")).alias("n_redacted_pages"), F.sum((F.col("state") == "full").cast("long")).alias("n_full_pages"))


def q_withheld_share(spark, sf_dir):
    """Withheld share by source: a quotient of areas, never a mean of ratios."""
    w, r = _both(spark, sf_dir)
    a = w.groupBy("doc_id").agg(F.sum(F.col("w") * F.col("h")).alias("ink"))
    b = r.groupBy("doc_id").agg(F.sum(F.col("w") * F.col("h")).alias("dark"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return a.join(b, "doc_id", "left").join(docs, "doc_id").groupBy("source").agg(F.round(F.coalesce(F.sum("dark"), F.lit(0.0)) / F.sum("ink"), 6).alias("withheld_share"), F.count("*").alias("n_documents"))


def q_page_notes(spark, sf_dir):
    note = F.when(F.col("state") == "full", "withheld in full").when(F.col("n_words") < 100, "few words").otherwise("none")
    rows = _states(spark, sf_dir).withColumn("note", note).where("note <> 'none'").groupBy("note").agg(F.count("*").alias("n_pages"), F.count_distinct("doc_id").alias("n_documents"))
    return rows


def q_leak_report(spark, sf_dir):
    """At most five findings a page, shown as shapes, with the count of the rest."""
    w, r = _both(spark, sf_dir)
    hit = spatial.covered(w, r)
    k = F.row_number().over(Window.partitionBy(*PAGE).orderBy("b_rid", "pos"))
    n = F.count("*").over(Window.partitionBy(*PAGE))
    return hit.withColumns({"k": k, "n": n}).where("k <= 5").select("doc_id", "page", "k", F.regexp_replace("text", r"[\p{L}\p{N}]", "#").alias("shape"), F.greatest(F.col("n") - 5, F.lit(0)).alias("n_more"))


# --- codes ---

#: The citation of a statutory code as the fixtures write it; look-behind keeps it off longer words.
CODE = r"(?<![A-Za-z0-9])\(\s{0,8}[bB]\s{0,8}\)\s{0,8}\(\s{0,8}([1-9])\s{0,8}\)"


def _coded(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    cite = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit(" (b)("), (F.col("doc_id") % 9 + 1).cast("string"), F.lit(") and (b) ("), (F.col("doc_id") % 4 + 1).cast("string"), F.lit(")"))).otherwise(F.lit(""))
    return d.select("doc_id", F.concat("text", cite).alias("text"))


def _hits(spark, sf_dir):
    return _coded(spark, sf_dir).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(CODE), F.lit(1))).alias("n")).select("doc_id", F.concat(F.lit("b("), "n", F.lit(")")).alias("code"))


def q_code_hits(spark, sf_dir):
    return _hits(spark, sf_dir).groupBy("doc_id", "code").agg(F.count("*").alias("n_hits"))


def q_code_counts(spark, sf_dir):
    """A code counts once a document."""
    return _hits(spark, sf_dir).distinct().groupBy("code").agg(F.count("*").alias("n_documents"))


def q_code_set_diff(spark, sf_dir):
    """Codes that the new release of a document adds and drops: documents are releases of the source's next one, in order within their source."""
    docs = _coded(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    sets = docs.select("doc_id", "source", F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(CODE), F.lit(1)), lambda n: F.concat(F.lit("b("), n, F.lit(")"))))).alias("codes")).where("size(codes) > 0")
    both = sets.withColumn("next", F.lead("codes").over(Window.partitionBy("source").orderBy("doc_id"))).where("next is not null")
    return both.select("doc_id", F.array_join(F.array_except("next", "codes"), ",").alias("added"), F.array_join(F.array_except("codes", "next"), ",").alias("removed"))


#: Citations by document: each text gets one of them, and what is read there.
CASES = [
    ("us", "see (b)(5) here", ["b(5)"]), ("us", "b(7)(C)", ["b(7)(C)"]), ("us", "5 U.S.C. 552(b)(6)", ["b(6)"]), ("us", "(b)(6)(b)(7)(C)", ["b(6)", "b(7)(C)"]), ("us", "(b)(7)(A)(2) or 7(b)(5)", ["b(7)"]), ("us", "(b)(7)(Z), (b)(O) and [b] [l]", ["b(7)", "b(1)"]),
    ("us", "Exemptions 6 and 7(C), 5; 200 pages", ["b(6)", "b(7)(C)", "b(5)"]), ("us", "(6)(6), and (b)(4)", ["b(6)", "b(4)"]), ("us", "(6)(6) alone", []), ("us", "(k)(2), k2 and (j)(2)", ["k(2)", "j(2)"]), ("us", "FOIA Exemption No. 7(e)", ["b(7)(E)"]), ("us", "a list: (5) no code", []),
    ("uk", "Section 40(2) and 41", ["s.40(2)", "s.41"]), ("uk", "the agency's 21 employees", []), ("uk", "s.21, 43; section 3, 40", ["s.21", "s.43"]), ("ca", "sections 19, 20 or 21", ["s.19", "s.20", "s.21"]), ("eu", "Article 4(1)(a) and (2)", ["art.4(1)(a)", "art.4(2)"]), ("eu", "Arts. 4 (3), 4(1)(c)", ["art.4(3)", "art.4(1)"]),
]


def q_citations(spark, sf_dir):
    """Citations behind whole texts, in each jurisdiction, with their places."""
    n = F.col("doc_id") % len(CASES) + 1
    pick = lambda k: F.element_at(F.array(*(F.lit(c[k]) for c in CASES)), n.cast("int"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("n_before"), pick(0).alias("law"), F.concat("text", F.lit(" | "), pick(1)).alias("text"))
    found = None
    for law in codes.VOCABULARIES:
        hits = codes.codes(docs.where(F.col("law") == law), jurisdiction=law)
        found = hits if found is None else found.unionByName(hits)
    found = found.join(docs.select("doc_id", "n_before"), "doc_id").where("start >= n_before")
    return found.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "code"))), lambda h: h["code"]), " ").alias("codes"), F.bool_and(F.col("end") - F.col("start") == F.length("raw")).alias("placed"))


#: The codes of the fixtures, in the order of their statute.
VOCABULARY = [f"b({k})" for k in range(1, 10)]


def q_legend(spark, sf_dir):
    """Codes found with their places in the texts, in the vocabulary's order."""
    return codes.legend(codes.codes(_coded(spark, sf_dir), VOCABULARY), VOCABULARY)


def q_markdown(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", markup.rendered(F.col("text")).alias("html"))


def q_cite(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("Doc "), F.col("doc_id").cast("string")).alias("t"), F.when(F.col("doc_id") % 2 == 0, F.col("doc_id") % 7).alias("p"), F.when(F.col("doc_id") % 3 == 0, F.lit("2024-01-02")).alias("d"))
    none = F.lit(None).cast("string")
    return d.select("doc_id", markup.citation("note", F.col("t"), F.col("p"), F.col("d"), none).alias("note"), markup.citation("link", F.col("t"), F.col("p"), F.col("d"), none).alias("link"))


def q_associate(spark, sf_dir):
    """Each box with the nearest word of its line that no box touches: gap in page heights, ties to the earlier word."""
    w, r = _both(spark, sf_dir)
    free = spatial.visible(w, r).select(*PAGE, F.col("y").alias("line_y"), "pos", F.col("x").alias("wx"), F.col("w").alias("ww"))
    pairs = r.join(free, (r["doc_id"] == free["doc_id"]) & (r["page"] == free["page"]) & (r["y"] == free["line_y"])).select(r["doc_id"], r["page"], "rid", "pos", F.round(F.greatest(F.lit(0.0), F.col("wx") - F.col("x") - F.col("w"), F.col("x") - F.col("wx") - F.col("ww")), 9).alias("gap"))
    best = F.row_number().over(Window.partitionBy(*PAGE, "rid").orderBy("gap", "pos"))
    return pairs.withColumn("k", best).where("k = 1 and gap <= 0.05").select("doc_id", "page", "rid", "pos")


_MEET = """meet as (select w.doc_id, w.page, w.pos, w.text, r.rid, w.w * w.h as area,
   (least(w.x + w.w, r.x + r.w) - greatest(w.x, r.x)) * (least(w.y + w.h, r.y + r.h) - greatest(w.y, r.y)) as shared
  from words w join redactions r on w.doc_id = r.doc_id and w.page = r.page and w.line = r.rid // 12 and w.x < r.x + r.w and r.x < w.x + w.w and w.y < r.y + r.h and r.y < w.y + w.h)"""


def _cells_sql(source: str) -> str:
    edge = lambda e, n, f: f"greatest(0, least({n}, {f}(round({e} * {n}, 9))))::int"
    return f"""select doc_id, page, sum(greatest(0, x2 - greatest(x1, coalesce(far, 0))))::bigint as cells from (
      select *, max(x2) over (partition by doc_id, page, row order by x1, x2 rows between unbounded preceding and 1 preceding) as far from (
        select doc_id, page, x1, x2, unnest(range(y1, y2)) as row from (
          select doc_id, page, {edge("x", 800, "floor")} as x1, {edge("(x + w)", 800, "ceil")} as x2, {edge("y", 1035, "floor")} as y1, {edge("(y + h)", 1035, "ceil")} as y2 from {source}) where x2 > x1 and y2 > y1)) group by all"""


_STATES = """n as (select doc_id, page, count(*) as n_boxes from redactions group by all), states as (
  select *, case when n_boxes >= 6 then 'full' when n_boxes >= 4 then 'part' when n_boxes >= 1 then 'some' else 'plain' end as state
  from (select doc_id, page, n_words, coalesce(n_boxes, 0) as n_boxes from (select doc_id, page, count(*) as n_words from words group by all) left join n using (doc_id, page)))"""
_NEXT = """nb as (select doc_id, page, rid, x as ax, y as ay, x + w as ax2, y + h as ay2, x + bw / 4 as bx, y + 0.005::double as by1, x + bw / 4 + bw as bx2, y + 0.005::double + bh as by2
  from (select *, lead(w) over (partition by doc_id, page order by rid) as bw, lead(h) over (partition by doc_id, page order by rid) as bh from redactions) where bw is not null),
  sh as (select *, case when least(ax2, bx2) > greatest(ax, bx) and least(ay2, by2) > greatest(ay, by1) then (least(ax2, bx2) - greatest(ax, bx)) * (least(ay2, by2) - greatest(ay, by1)) else 0.0::double end as s, (ax2 - ax) * (ay2 - ay) as aa, (bx2 - bx) * (by2 - by1) as ba from nb)"""
_CODED = r"""coded as (select doc_id, text || case when doc_id % 5 = 0 then ' (b)(' || (doc_id % 9 + 1) || ') and (b) (' || (doc_id % 4 + 1) || ')' else '' end as text from documents),
  hits as (select doc_id, 'b(' || n || ')' as code from (select doc_id, unnest(regexp_extract_all(text, '\(\s{0,8}[bB]\s{0,8}\)\s{0,8}\(\s{0,8}([1-9])\s{0,8}\)', 1)) as n from coded))"""

ORACLE = {
    "q_drop_hidden": f"with {WORDS_SQL}, {_MEET} select doc_id, page, count(*) as n_visible, sum(pos)::bigint as pos_sum from words w where not exists (select 1 from meet m where m.doc_id = w.doc_id and m.page = w.page and m.pos = w.pos) group by all",
    "q_hidden_text": f"with {WORDS_SQL}, {_MEET} select doc_id, page, rid, pos from meet where shared / area > 0.8",
    "q_words_in_regions": f"with {WORDS_SQL}, {_MEET} select doc_id, page, pos, round(sum(shared / area), 6) as inside from meet group by all having sum(shared / area) >= 0.6",
    "q_area_union": f"with {WORDS_SQL} {_cells_sql('redactions')}",
    "q_redaction_ratio": f"""with {WORDS_SQL}, b as ({_cells_sql("redactions")}), i as ({_cells_sql("(select doc_id, page, x, y, w, h from words union all select doc_id, page, x, y, w, h from redactions)")})
      select doc_id, page, i.cells as ink_cells, coalesce(b.cells, 0) as cells, round(coalesce(b.cells, 0) / i.cells, 6) as ratio from i left join b using (doc_id, page)""",
    "q_layout_profile": f"""with {WORDS_SQL}, c as (select *, unnest(range(greatest(0, least(7, floor(x * 8)))::int, greatest(0, least(7, floor((x + w) * 8)))::int + 1)) as cx from words),
      d as (select *, unnest(range(greatest(0, least(11, floor(y * 12)))::int, greatest(0, least(11, floor((y + h) * 12)))::int + 1)) as cy from c),
      s as (select doc_id, page, (cy * 8 + cx)::int as cell, least(1.0, sum(greatest(0.0, least(x + w, (cx + 1) / 8.0::double) - greatest(x, cx / 8.0::double)) * greatest(0.0, least(y + h, (cy + 1) / 12.0::double) - greatest(y, cy / 12.0::double)) * 96)) as share from d group by all)
      select doc_id, page, cell, round(share, 6) as share from s where share > 0""",
    "q_locate": f"with {WORDS_SQL}, o as (select *, coalesce(sum(length(text) + 1) over (partition by doc_id, page order by pos rows between unbounded preceding and 1 preceding), 0)::bigint as start from words), t as (select *, unnest(range(start // 100, (start + length(text) - 1) // 100 + 1)) as stretch from o) select doc_id, page, stretch, round(min(x), 6) as x1, round(min(y), 6) as y1, round(max(x + w), 6) as x2, round(max(y + h), 6) as y2 from t group by all",
    "q_box_ops": f"with {WORDS_SQL}, {_NEXT} select doc_id, page, rid, round(s, 6) as shared, round(s / aa, 6) as ratio, round(s / (aa + ba - s), 6) as iou, round(sqrt(((ax + ax2 - bx - bx2) / 2) ** 2 + ((ay + ay2 - by1 - by2) / 2) ** 2), 6) as shift from sh",
    "q_subtract": f"""with {WORDS_SQL}, {_NEXT}, p as (select doc_id, page, rid, unnest(case when s > 0 then [
        {{x1: ax, y1: ay, x2: ax2, y2: least(by1, ay2)}}, {{x1: ax, y1: greatest(by2, ay), x2: ax2, y2: ay2}},
        {{x1: ax, y1: greatest(ay, by1), x2: least(bx, ax2), y2: least(ay2, by2)}}, {{x1: greatest(bx2, ax), y1: greatest(ay, by1), x2: ax2, y2: least(ay2, by2)}}] else [{{x1: ax, y1: ay, x2: ax2, y2: ay2}}] end) as b from sh)
      select doc_id, page, rid, count(*) as n_pieces, round(sum((b.x2 - b.x1) * (b.y2 - b.y1)), 6) as left_area from p where b.x2 > b.x1 and b.y2 > b.y1 group by all""",
    "q_page_states": f"with {WORDS_SQL}, {_STATES} select state, count(*) as n_pages, sum(n_boxes)::bigint as n_boxes from states group by state",
    "q_ribbon_rle": f"""with {WORDS_SQL}, {_STATES}, r as (select *, (coalesce(lag(state) over (partition by doc_id order by page), '') <> state)::int as new from states),
      s as (select *, sum(new) over (partition by doc_id order by page) as run from r) select doc_id, run::bigint as run, min(state) as state, min(page) as first_page, count(*) as n_pages from s group by doc_id, run""",
    "q_worst_pages": f"with {WORDS_SQL}, {_STATES} select doc_id, page, n_boxes from states order by n_boxes desc, doc_id, page limit 12",
    "q_negative_topk": f"""with {WORDS_SQL} select * from (select 'kept' as part, doc_id, page, rid, 1::bigint as n from redactions order by round(w * h, 6) desc, doc_id, page, rid limit 500)
      union all select 'left out', null, null, null, greatest(count(*) - 500, 0) from redactions""",
    "q_summarise": f"with {WORDS_SQL}, {_STATES} select count(distinct doc_id) as n_documents, count(*) as n_pages, sum(n_words)::bigint as n_words, sum(n_boxes)::bigint as n_boxes, count(*) filter (n_boxes > 0) as n_redacted_pages, count(*) filter (state = 'full') as n_full_pages from states",
    "q_withheld_share": f"""with {WORDS_SQL}, a as (select doc_id, sum(w * h) as ink from words group by 1), b as (select doc_id, sum(w * h) as dark from redactions group by 1)
      select source, round(coalesce(sum(dark), 0.0) / sum(ink), 6) as withheld_share, count(*) as n_documents from a left join b using (doc_id) join documents using (doc_id) group by source""",
    "q_page_notes": f"""with {WORDS_SQL}, {_STATES} select note, count(*) as n_pages, count(distinct doc_id) as n_documents from
      (select *, case when state = 'full' then 'withheld in full' when n_words < 100 then 'few words' else 'none' end as note from states) where note <> 'none' group by note""",
    "q_leak_report": f"""with {WORDS_SQL}, {_MEET} select doc_id, page, k::int as k, shape, n_more from (
      select doc_id, page, row_number() over (partition by doc_id, page order by rid, pos) as k, regexp_replace(text, '[\\p{{L}}\\p{{N}}]', '#', 'g') as shape, greatest(count(*) over (partition by doc_id, page) - 5, 0) as n_more from meet where shared / area > 0.8) where k <= 5""",
    "q_code_hits": f"with {_CODED} select doc_id, code, count(*) as n_hits from hits group by all",
    "q_code_counts": f"with {_CODED} select code, count(distinct doc_id) as n_documents from hits group by code",
    "q_code_set_diff": f"""with {_CODED}, s as (select doc_id, list_sort(list(distinct code)) as codes from hits group by doc_id), t as (select doc_id, codes, lead(codes) over (partition by source order by doc_id) as next from s join documents using (doc_id))
      select doc_id, array_to_string(list_filter(next, lambda c: not list_contains(codes, c)), ',') as added, array_to_string(list_filter(codes, lambda c: not list_contains(next, c)), ',') as removed from t where next is not null""",
    "q_citations": "with c(n, codes) as (values " + ", ".join(f"({k}, '{' '.join(c)}')" for k, (_, _, c) in enumerate(CASES) if c) + f") select doc_id, codes, true as placed from documents join c on doc_id % {len(CASES)} = n",
    "q_legend": f"with {_CODED} select code, count(distinct doc_id) as n_documents, regexp_extract(code, '([1-9])\\)$', 1)::int as place from hits group by code",
    "q_cite": """select doc_id, t || coalesce(d, '') || coalesce(p, '') as note, '[' || t || coalesce(p, '') || '](#)' as link from (select doc_id, 'Doc ' || doc_id as t,
      case when doc_id % 2 = 0 then ', p. ' || (doc_id % 7) end as p, case when doc_id % 3 = 0 then ' (2024-01-02)' end as d from documents)""",
    "q_associate": f"""with {WORDS_SQL}, {_MEET}, f as (select * from words w where not exists (select 1 from meet m where m.doc_id = w.doc_id and m.page = w.page and m.pos = w.pos)),
      p as (select r.doc_id, r.page, r.rid, f.pos, round(greatest(0.0, f.x - r.x - r.w, r.x - f.x - f.w), 9) as gap from redactions r join f on r.doc_id = f.doc_id and r.page = f.page and r.y = f.y)
      select doc_id, page, rid, pos from (select *, row_number() over (partition by doc_id, page, rid order by gap, pos) as k from p) where k = 1 and gap <= 0.05""",
}
QUERIES = {k: v for k, v in globals().items() if k.startswith("q_")}
