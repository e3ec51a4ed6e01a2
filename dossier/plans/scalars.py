"""Queries on page frames, locales and short texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from dossier.functions import frames, locales, phrases
from dossier.sources.corpus import table

MONTHS = "January February March April May June July August September October November December".split()


def _parts(spark, sf_dir):
    return table(spark, sf_dir, "part")


def _pick(values, by):
    return F.element_at(F.array(*(F.lit(v) for v in values)), (by % len(values) + 1).cast("int"))


def q_box_shapes(spark, sf_dir):
    """Shared and bounding boxes of neighbours, as fractions and in whole parts."""
    p = _parts(spark, sf_dir).select("p_partkey", (F.col("p_size") / 100).alias("a"), (F.col("p_partkey") % 40 / 100).alias("b"))
    one, two = (F.col("a"), F.col("b"), F.col("a") + 0.2, F.col("b") + 0.1), (F.lit(0.3), F.lit(0.2), F.lit(0.5), F.lit(0.45))
    both, around = frames.intersection(one, two), frames.union(one, two)
    return p.select("p_partkey", F.round(both["w"] * both["h"], 8).alias("shared"), F.round(around["w"] * around["h"], 8).alias("around"), F.array_join(frames.to_parts(*one), ",").alias("parts"), F.round(frames.from_parts(frames.to_parts(*one))[0], 6).alias("back"))


def q_page_frames(spark, sf_dir):
    """What is shown of cropped and turned pages, and where a rectangle stands in it."""
    p = _parts(spark, sf_dir).select("p_partkey", F.col("p_size").cast("double").alias("s"), _pick([0, 90, 180, 270], F.col("p_partkey")).alias("turn"))
    media, crop = frames.upright(F.lit(612.0), F.lit(0.0), F.lit(0.0), F.lit(792.0)), frames.upright(F.col("s"), F.col("s") * 2, F.lit(500.0) + F.col("s") * 4, F.when(F.col("p_partkey") % 7 == 0, F.lit(-5.0)).otherwise(700.0))
    shown = frames.displayed(media, crop, F.col("turn"), F.lit(612.0), F.lit(792.0))
    rows = p.select("p_partkey", shown.alias("f"), frames.flipped(frames.upright(F.lit(100.0), F.lit(300.0), F.lit(200.0), F.lit(250.0)), shown["h"], shown["dx"], shown["dy"]).alias("e"), F.col("s"))
    box = frames.from_points(F.col("e.left"), F.col("e.top"), F.col("e.right"), F.col("e.bottom"), F.col("f.w"), F.col("f.h"))
    return rows.select("p_partkey", "f.*", "e.top", "e.left", F.round(box["x"], 8).alias("x"), F.round(box["h"], 8).alias("bh"))


def q_turned_boxes(spark, sf_dir):
    p = _parts(spark, sf_dir).select("p_partkey", (F.col("p_size") / 100).alias("x"), (F.col("p_partkey") % 50 / 100).alias("y"), _pick([0, 90, 180, 270, -90], F.col("p_partkey")).alias("d"))
    b = frames.turned_back(F.col("x"), F.col("y"), F.lit(0.2), F.lit(0.1), F.col("d"))
    return p.select("p_partkey", *(F.round(b[c], 6).alias(c) for c in "xywh"))


def q_resolutions(spark, sf_dir):
    p = _parts(spark, sf_dir).select("p_partkey", (F.col("p_size") * 20.0).alias("w"), (F.col("p_partkey") % 90 * 10.0).alias("h"))
    dpi = frames.resolution(F.col("w"), F.col("h"), F.lit(150), F.lit(1600), F.lit(4_000_000))
    return p.select("p_partkey", dpi.alias("dpi"), frames.pixels(F.col("w"), F.lit(150)).alias("pixels"), frames.fitted(F.col("w"), F.col("h"), F.lit(150), F.lit(1_000_000)).alias("fitted"), F.round(frames.proportion(F.col("w"), F.col("h")), 6).alias("proportion"))


def q_plural_rules(spark, sf_dir):
    """All rules, on whole and broken numbers."""
    n = F.concat(F.col("p_partkey").cast("string"), _pick(["", ".0", ".5", ""], F.col("p_partkey")))
    p = _parts(spark, sf_dir).select("p_partkey", F.when(F.col("p_partkey") % 9 == 0, F.lit("1.0")).otherwise(n).alias("n"))
    return p.select("p_partkey", "n", *(locales.plural(r, F.col("n")).alias(r) for r in sorted(set(locales.RULE.values()))))


def q_ambiguous_forms(spark, sf_dir):
    out = None
    for rule in sorted(set(locales.RULE.values())):
        rows = locales.ambiguous(spark, rule).withColumn("rule", F.lit(rule))
        out = rows if out is None else out.unionByName(rows)
    return out


def q_locale_numbers(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("v"))
    return o.select("o_orderkey", locales.number(F.floor("v")).alias("en"), locales.number(F.floor("v") % 10000, 0, ".", ",", 2).alias("es"), locales.number(F.floor("v") / 4, 2, " ", ",").alias("ru"))


def q_locale_dates(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 10 == 0, "unknown").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("iso"))
    return o.select("o_orderkey", locales.date(F.col("iso"), MONTHS).alias("long"), locales.date(F.col("iso"), [m[:3] for m in MONTHS], "m d y").alias("short"))


def q_locale_codes(spark, sf_dir):
    p = _parts(spark, sf_dir).select("p_partkey", _pick(["EN", "pt_br", "he", " ar-EG ", "", "zh-hans"], F.col("p_partkey")).alias("c"))
    return p.select("p_partkey", locales.locale(F.col("c")).alias("locale"), locales.direction(F.trim("c")).alias("direction"))


def q_catalogue_check(spark, sf_dir):
    """A catalogue against its source: keys of parts, some lost, some too many, some with other names."""
    p = _parts(spark, sf_dir).select(F.col("p_partkey").alias("k"), F.concat(F.lit("m."), F.col("p_partkey").cast("string")).alias("key"), "p_name")
    none = F.lit(None).cast("string")
    message = F.concat("p_name", F.lit(" {count} of {total}"))
    source = p.where("k % 3 <> 0").select("key", none.alias("form"), message.alias("message")).unionByName(p.where("k % 3 = 0").select("key", F.explode(F.array(F.lit("one"), F.lit("other"))).alias("form"), message.alias("message")))
    own = F.concat("p_name", F.when(F.col("k") % 11 == 0, " {cuont}").otherwise(" {count}"))
    other = p.where("k % 3 <> 0 and k % 7 <> 0").select("key", none.alias("form"), own.alias("message")).unionByName(p.where("k % 3 = 0").select("key", F.explode(F.when(F.col("k") % 5 == 0, F.array(F.lit("one"), F.lit("few"), F.lit("many"), F.lit("other"))).otherwise(F.array(F.lit("one"), F.lit("two")))).alias("form"), own.alias("message")))
    return locales.checked(other, source, locales.FORMS["east_slavic"].split())


def q_messages(spark, sf_dir):
    p = _parts(spark, sf_dir)
    text = F.concat(F.lit("{name}: {count} pages of {name}, {other}"))
    return p.select("p_partkey", locales.translated(text, {"name": F.col("p_name"), "count": F.col("p_size")}).alias("text"), F.array_join(locales.placeholders(text), ",").alias("names"))


def q_short_texts(spark, sf_dir):
    p = _parts(spark, sf_dir)
    v = F.col("p_size") / 4000 - 0.0005
    return p.select("p_partkey", phrases.truncated(F.concat_ws("  ", "p_name", "p_name", "p_type"), 40).alias("cut"), phrases.code_slug(_pick(["b(7)(C)", "s.40(2)", "", "()"], F.col("p_partkey"))).alias("slug"), phrases.short_number(F.col("p_partkey") / 8).alias("number"), phrases.share_band(v).alias("band"), phrases.extent_band(v * 200).alias("extent"))


def q_titles(spark, sf_dir):
    claimed = ["  A report ", "", "ab", "Untitled", "x.PDF", "Microsoft Word - y", "1f2e-3d4c-5b6a-7980-aa", "a - b - c - d - e"]
    p = _parts(spark, sf_dir).select("p_partkey", _pick(claimed, F.col("p_partkey")).alias("c"), F.concat(F.lit("my_file-"), F.col("p_partkey").cast("string")).alias("stem"))
    return p.select("p_partkey", phrases.title(F.col("c"), F.col("stem")).alias("title"), phrases.about_safety(_pick(["Text is HIDDEN here", "few words", "the redaction check did not run", "blurred"], F.col("p_partkey"))).alias("safety"))


def q_page_states_all(spark, sf_dir):
    p = _parts(spark, sf_dir)
    return p.select("p_partkey", phrases.page_state(F.col("p_partkey") % 11 == 0, F.col("p_size") / 50, F.col("p_partkey") % 3, _pick(["blank", "good"], F.col("p_partkey"))).alias("state"), phrases.published_suffix(_pick(["pdf", "png", "html", "jpeg"], F.col("p_partkey"))).alias("suffix"))


def q_index_sizes(spark, sf_dir):
    p = _parts(spark, sf_dir).select("p_partkey", (F.col("p_partkey") * 41).alias("n"))
    return p.select("p_partkey", phrases.first_search_bytes(F.col("n")).alias("bytes"), phrases.scale_warning(F.col("n")).alias("warning"))


def _choose(values, key: str) -> str:
    return "([" + ", ".join("'" + str(v).replace("'", "''") + "'" if isinstance(v, str) else str(v) for v in values) + f"])[{key} % {len(values)} + 1]"


_FEW = "i % 10 between 2 and 4 and i % 100 not between 12 and 14"
_PLURALS = {
    "one_i": "case when i = 1 and v = 0 then 'one' else 'other' end", "one_n": "case when n = 1 then 'one' else 'other' end", "one_zero": "case when i <= 1 then 'one' else 'other' end", "other": "'other'",
    "east_slavic": f"case when v > 0 then 'other' when i % 10 = 1 and i % 100 <> 11 then 'one' when {_FEW} then 'few' else 'many' end", "polish": f"case when v > 0 then 'other' when i = 1 then 'one' when {_FEW} then 'few' else 'many' end",
    "arabic": "case when n = 0 then 'zero' when n = 1 then 'one' when n = 2 then 'two' when v > 0 then 'other' when i % 100 between 3 and 10 then 'few' when i % 100 >= 11 then 'many' else 'other' end", "hebrew": "case when v > 0 then 'other' when i = 1 then 'one' when i = 2 then 'two' else 'other' end",
}
_GROUPED = "regexp_replace(format('{{:,}}', {v}), ',', '{g}', 'g')"

ORACLE = {
    "q_box_shapes": """with p as (select p_partkey, p_size / 100 as a, p_partkey % 40 / 100 as b from part)
      select p_partkey, case when least(a + 0.2, 0.5) > greatest(a, 0.3) and least(b + 0.1, 0.45) > greatest(b, 0.2) then round((least(a + 0.2, 0.5) - greatest(a, 0.3)) * (least(b + 0.1, 0.45) - greatest(b, 0.2)), 8) end as shared,
        round((greatest(a + 0.2, 0.5) - least(a, 0.3)) * (greatest(b + 0.1, 0.45) - least(b, 0.2)), 8) as around, p_size * 100 || ',' || (p_partkey % 40) * 100 || ',' || (p_size * 100 + 2000) || ',' || ((p_partkey % 40) * 100 + 1000) as parts, round(p_size / 100, 6) as back from p join part using (p_partkey)""",
    "q_page_frames": f"""with p as (select p_partkey, p_size::double as s, {_choose([0, 90, 180, 270], "p_partkey")} as turn, case when p_partkey % 7 = 0 then -5.0 else 700.0 end as e from part),
      c as (select *, least(612, 500 + s * 4) as x1, s as x0, greatest(0.0, least(s * 2, e)) as y0, least(792, greatest(s * 2, e)) as y1 from p),
      d as (select *, x1 > x0 and y1 > y0 as cut from c),
      f as (select p_partkey, case when not cut then 612 when turn in (90, 270) then y1 - y0 else x1 - x0 end::double as w, case when not cut then 792 when turn in (90, 270) then x1 - x0 else y1 - y0 end::double as h,
        case when not cut then 0 when turn = 0 then x0 when turn = 90 then y0 when turn = 180 then 612 - x1 else 792 - y1 end::double as dx, case when not cut then 0 when turn = 0 then y0 when turn = 90 then 612 - x1 when turn = 180 then 792 - y1 else x0 end::double as dy from d)
      select p_partkey, w, h, dx, dy, h - (300 - dy) as top, 100 - dx as "left", round((100 - dx) / w, 8) as x, round(50 / h, 8) as bh from f""",
    "q_turned_boxes": f"""with p as (select p_partkey, p_size / 100 as x, p_partkey % 50 / 100 as y, {_choose([0, 90, 180, 270, 270], "p_partkey")} as d from part)
      select p_partkey, round(case d when 90 then y when 180 then 0.8 - x when 270 then 0.9 - y else x end, 6) as x, round(case d when 90 then 0.8 - x when 180 then 0.9 - y when 270 then x else y end, 6) as y, case when d in (90, 270) then 0.1 else 0.2 end::double as w, case when d in (90, 270) then 0.2 else 0.1 end::double as h from p""",
    "q_resolutions": """with p as (select p_partkey, p_size * 20.0::double as w, (p_partkey % 90 * 10)::double as h from part)
      select p_partkey, case when h > 0 then greatest(1, least(greatest(150, ceil(1600 * 72 / w)), floor(72 * sqrt(4000000 / (w * h))))) else 150 end::int as dpi, greatest(1, ceil(w * 150 / 72))::bigint as pixels,
        coalesce(list_max(list_filter(range(1, 151), lambda d: greatest(1, ceil(w * d / 72)) * greatest(1, ceil(h * d / 72)) <= 1000000)), 1)::int as fitted, round(case when h > 0 then w / h else 612 / 792.0::double end, 6) as proportion from p""",
    "q_plural_rules": f"""with p as (select p_partkey, case when p_partkey % 9 = 0 then '1.0' else p_partkey || {_choose(["", ".0", ".5", ""], "p_partkey")} end as t from part), o as (select p_partkey, t, split_part(t, '.', 1)::bigint as i, length(split_part(t, '.', 2)) as v, t::double as n from p)
      select p_partkey, t as n, {", ".join(f"{sql} as {rule}" for rule, sql in _PLURALS.items())} from o""",
    "q_ambiguous_forms": "with o as (select n as i, 0 as v, n from range(201) t(n)) " + " union all ".join(f"select '{rule}' as rule, category from (select {sql} as category, count(*) as n from o group by 1) where n > 1" for rule, sql in _PLURALS.items()),
    "q_locale_numbers": f"""with o as (select o_orderkey, floor(o_totalprice)::bigint as v from orders) select o_orderkey, format('{{:,}}', v) as en, case when v % 10000 < 10000 then (v % 10000)::varchar end as es,
      {_GROUPED.format(v="v // 4", g=" ")} || ',' || (['00', '25', '50', '75'])[v % 4 + 1] as ru from o""",
    "q_locale_dates": f"""with o as (select o_orderkey, o_orderdate::date as d, ({MONTHS!r})[month(o_orderdate)] as m from orders) select o_orderkey, case when o_orderkey % 10 = 0 then 'unknown' else day(d) || ' ' || m || ' ' || year(d) end as long, case when o_orderkey % 10 = 0 then 'unknown' else m[1:3] || ' ' || day(d) || ' ' || year(d) end as short from o""",
    "q_locale_codes": f"""select p_partkey, nullif({_choose(["en", "pt-BR", "he", "ar-EG", "", "zh-HANS"], "p_partkey")}, '') as locale, case when p_partkey % 6 in (2, 3) then 'rtl' else 'ltr' end as direction from part""",
    "q_catalogue_check": """with p as (select p_partkey as k, 'm.' || p_partkey as key from part), have as (select k, key, '' as form from p where k % 3 <> 0 and k % 7 <> 0 union all select k, key, unnest(case when k % 5 = 0 then ['one', 'few', 'many', 'other'] else ['one', 'two'] end) from p where k % 3 = 0),
      want as (select key, '' as form from p where k % 3 <> 0 union all select key, unnest(['one', 'few', 'many', 'other']) from p where k % 3 = 0)
      select key, form, 'missing' as problem from want where (key, form) not in (select (key, form) from have) union all select key, form, 'extra' from have where (key, form) not in (select (key, form) from want) union all select key, form, 'unknown placeholder' from have where k % 11 = 0""",
    "q_messages": "select p_partkey, p_name || ': ' || p_size || ' pages of ' || p_name || ', {other}' as text, 'count,name,other' as names from part",
    "q_short_texts": f"""with p as (select p_partkey, p_size / 4000 - 0.0005 as v, regexp_replace(p_name || ' ' || p_name || ' ' || p_type, '\\s+', ' ', 'g') as t from part)
      select p_partkey, case when length(t) <= 40 then t else rtrim(t[1:39]) || '…' end as cut, {_choose(["b7c", "s402", "none", "none"], "p_partkey")} as slug,
        regexp_replace(regexp_replace(printf('%.2f', floor(p_partkey * 100 / 8 + 0.5) / 100), '0+$', ''), '\\.$', '') as number, case when v <= 0 then 'none' when v < 0.001 then 'tiny' when v < 0.01 then 'small' else 'large' end as band,
        case when v * 200 >= 1.95 then 'pages' when v * 200 >= 0.95 then 'page' when v * 200 >= 0.01 then 'share' when v * 200 >= 0.001 then 'small share' else 'tiny' end as extent from p""",
    "q_titles": f"""select p_partkey, case p_partkey % 8 when 0 then 'A report' when 7 then 'a - b - c - d - e' else 'my file ' || p_partkey end as title, p_partkey % 4 in (0, 2) as safety from part""",
    "q_page_states_all": f"""select p_partkey, case when p_partkey % 11 = 0 then 'dark' when p_size / 50 >= 0.9 then 'full' when p_partkey % 3 > 0 then 'part' when p_partkey % 2 = 0 then 'void' else 'plain' end as state, {_choose([".pdf", ".png", ".bin", ".jpg"], "p_partkey")} as suffix from part""",
    "q_index_sizes": "select p_partkey, (97151 + round_even(p_partkey * 41 * 5.5, 0))::bigint as bytes, case when p_partkey * 41 > 50000 then 'refused' when p_partkey * 41 > 20000 then 'slow' end as warning from part",
}
QUERIES = {k: v for k, v in globals().items() if k.startswith("q_")}
