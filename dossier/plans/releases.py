"""Queries on series, comparison, search, incremental work and formats."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from dossier.functions import formats
from dossier.operators import compare, search, series
from dossier.sources.corpus import WORDS_SQL, table, words
from dossier.streaming import watch


def _stamps(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("series"), F.col("o_orderkey").alias("value"))
    return o.withColumn("page", F.row_number().over(Window.partitionBy("series").orderBy("value")))


def q_bates_gaps(spark, sf_dir):
    return series.gaps(_stamps(spark, sf_dir))


def q_bates_coverage(spark, sf_dir):
    return series.coverage(_stamps(spark, sf_dir)).withColumn("coverage", F.round("coverage", 6))


def q_monotone_runs(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("series"), F.col("l_partkey").alias("value"), F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")).alias("page"))
    return series.monotone_runs(rows)


def q_parsed_stamps(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("ABC-"), F.lpad(F.translate(F.col("o_orderkey").cast("string"), "0", "O"), 8, "0")).alias("stamp"))
    return series.parsed(o).select("stamp", "prefix", "value")


def q_stamp_prefix(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.lpad(F.col("o_orderkey").cast("string"), 8, "0").alias("stamp"))
    return o.where(F.startswith("stamp", F.lit("000001"))).orderBy("stamp").limit(6)


def q_doc_pairs(spark, sf_dir):
    old = F.coalesce(F.regexp_extract("source", r"(\d+)$", 1).try_cast("int") < 10, F.lit(False))
    return compare.matched(table(spark, sf_dir, "documents").select("doc_id", "text", old.alias("old")), 0.3)


def q_bracket(spark, sf_dir):
    """Pairs of lines, with a confidence that the quantity decides."""
    level = F.element_at(F.array(*map(F.lit, ("low", "high", "certain", "medium"))), (F.col("l_quantity").cast("int") % 4 + 1))
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("pair"), F.col("l_linenumber").alias("i")).agg(F.min("l_quantity").alias("l_quantity"))
    return compare.bracketed(rows.select("pair", "i", F.col("i").alias("j"), level.alias("confidence")))


def q_postings(spark, sf_dir):
    return search.postings(words(table(spark, sf_dir, "documents"))).groupBy("term").agg(F.count("*").alias("n_pages"), F.sum(F.size("positions")).alias("n_hits"))


def q_search_and(spark, sf_dir):
    return search.found(words(table(spark, sf_dir, "documents")), ["the", "and", "with"], 12).select("doc_id", "page", "n_hits", F.array_join("positions", ",").alias("positions"))


def q_phrase(spark, sf_dir):
    return search.phrase(words(table(spark, sf_dir, "documents")), ["of", "the"])


def q_fuzzy(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", search.tier(F.col("p_name"), "re").alias("tier")).where("tier is not null")


def q_page_resolver(spark, sf_dir):
    """'name 2' to the page of that number, where the document has it."""
    d = words(table(spark, sf_dir, "documents")).groupBy("doc_id").agg(F.max("page").alias("n_pages"))
    asked = d.withColumn("asked", F.concat(F.lit("memo "), (F.col("doc_id") % 4).cast("string")))
    page = F.regexp_extract("asked", r" ([1-9][0-9]*)$", 1)
    return asked.withColumn("page", F.nullif(page, F.lit("")).cast("int")).where("page <= n_pages").select("doc_id", "page")


def q_dedupe(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    first = d.groupBy("sha256").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n_copies"))
    return d.join(first, "sha256").select("doc_id", F.when(F.col("doc_id") > F.col("first_id"), F.col("first_id")).alias("duplicate_of"), "n_copies")


def q_collection_digest(spark, sf_dir):
    """Digest of each source's texts that doesn't depend on their order: a digest over those of 4096 runs, so no task holds a source's list."""
    d = table(spark, sf_dir, "documents").select("source", F.sha2("text", 256).alias("sha")).withColumn("run", F.substring("sha", 1, 3))
    joined = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), ""), 256)
    return d.groupBy("source", "run").agg(joined("sha").alias("part")).groupBy("source").agg(joined(F.concat("run", "part")).alias("digest"))


def q_snapshot_diff(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("path"), F.col("event_id").alias("size"), F.col("event_id").alias("modified"), (F.col("event_id") % 2).alias("half"))
    snap = lambda k: e.where(F.col("half") == k).groupBy("path").agg(F.max("size").alias("size"), (F.max("modified") - F.max("modified") % 1000).alias("modified"))
    return watch.changes(snap(0).withColumn("size", F.col("modified")), snap(1).withColumn("size", F.col("modified")))


def q_debounce(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "ts")
    return watch.settled(e, "1 hour")


def q_memo_misses(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.concat_ws("|", F.md5("text"), F.lit("v1")), 256).alias("key"))
    return watch.missing(d, d.where("doc_id % 3 <> 0")).select("doc_id", "key")


def q_prune(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("key"), (F.col("event_id") % 97 + 1).alias("bytes"), F.col("ts").alias("used"))
    return watch.pruned(e, 100_000).select("key", "kept")


def q_plural(spark, sf_dir):
    n = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("n"))
    return n.select("n", *[formats.plural(r, F.col("n")).alias(r) for r in ("east_slavic", "polish", "arabic", "hebrew", "one")])


def q_number_formats(spark, sf_dir):
    n = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") * F.col("o_custkey") * 37).alias("n"))
    return n.select("k", formats.grouped(F.col("n")).alias("grouped"), formats.human_seconds(F.col("k")).alias("seconds"))


def q_parse_size(spark, sf_dir):
    n = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.col("p_size").cast("string"), F.element_at(F.array(*map(F.lit, ("KB", " m", "GiB", "", " apples"))), (F.col("p_partkey") % 5 + 1).cast("int"))).alias("asked"))
    return n.select("p_partkey", "asked", formats.parse_size(F.col("asked")).alias("bytes"))


def q_pdf_date(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("D:"), F.date_format("o_orderdate", "yyyyMMddHHmmss"), F.when(F.col("o_orderkey") % 3 == 0, "+02'00'").when(F.col("o_orderkey") % 3 == 1, "Z").otherwise(" odd")).alias("raw"))
    return o.select("o_orderkey", formats.pdf_date(F.col("raw")).alias("iso"))


def q_bursts_by_type(spark, sf_dir):
    """Events in day windows by type: the tumbling roll-up that a stream of them keeps."""
    return table(spark, sf_dir, "events").groupBy("event_type", F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n_events"), F.round(F.sum("value"), 4).alias("total")).select("event_type", F.col("w.start").alias("day"), "n_events", "total")


def q_findings(spark, sf_dir):
    """Runs of consecutive tokens under one box, with their extent."""
    from dossier.operators import spatial
    from dossier.sources.corpus import redactions

    w = words(table(spark, sf_dir, "documents"))
    hit = spatial.covered(w, redactions(w)).select("doc_id", "page", "pos", "x", "w").distinct()
    island = F.col("pos") - F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("pos"))
    return hit.withColumn("island", island).groupBy("doc_id", "page", "island").agg(F.min("pos").alias("first_pos"), F.count("*").alias("n_tokens"), F.round(F.max(F.col("x") + F.col("w")), 6).alias("x2")).drop("island")


_STAMPS = "stamps as (select o_custkey as series, o_orderkey as value from orders)"
_TERM = "terms as (select regexp_replace(lower(translate(text, '‘’‛ʼ´‐‑‒–—―−', '''''''''''-------')), '^[\\p{P}\\p{S}]+|[\\p{P}\\p{S}]+$', '', 'g') as term, doc_id, page, pos from words)"
_SECONDS = "case when k < 60 then k || ' s' when k < 3600 then (k // 60) || ' min ' || (k % 60) || ' s' else (k // 3600) || ' h ' || (k % 3600 // 60) || ' min' end"

ORACLE = {
    "q_bates_gaps": f"with {_STAMPS} select series, value + 1 as lo, next - 1 as hi, next - value - 1 as n from (select series, value, lead(value) over (partition by series order by value) as next from (select distinct * from stamps)) where next > value + 1",
    "q_bates_coverage": f"with {_STAMPS} select series, min(value) as first, max(value) as last, count(distinct value) as n_values, max(value) - min(value) + 1 - count(distinct value) as n_missing, round(count(distinct value) / (max(value) - min(value) + 1)::double, 6) as coverage from stamps group by series",
    "q_monotone_runs": """with s as (select l_suppkey as series, l_partkey as value, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_extendedprice)::int as page from lineitem),
      b as (select *, coalesce((value < lag(value) over (partition by series order by page))::int, 0) as back from s), r as (select *, sum(back) over (partition by series order by page)::bigint as run from b)
      select series, run, min(page) as first_page, count(*) as n_pages, min(value) as lo, max(value) as hi from r group by series, run""",
    "q_parsed_stamps": "select stamp, 'ABC' as prefix, o_orderkey as value from (select o_orderkey, 'ABC-' || lpad(replace(o_orderkey::varchar, '0', 'O'), 8, '0') as stamp from orders)",
    "q_stamp_prefix": "select o_orderkey, stamp from (select o_orderkey, lpad(o_orderkey::varchar, 8, '0') as stamp from orders) where starts_with(stamp, '000001') order by stamp limit 6",
    "q_bracket": """with r as (select l_orderkey as pair, l_linenumber as i, (['low', 'high', 'certain', 'medium'])[min(l_quantity)::int % 4 + 1] as c from lineitem group by all)
      select pair, i, i as j, case when c = 'low' and coalesce(lag(i) over w = i - 1 and lag(c) over w in ('certain', 'high'), false) and coalesce(lead(i) over w = i + 1 and lead(c) over w in ('certain', 'high'), false) then 'medium' else c end as confidence
      from r window w as (partition by pair order by i)""",
    "q_postings": f"with {WORDS_SQL}, {_TERM} select term, count(distinct (doc_id, page)) as n_pages, count(*) as n_hits from terms where term <> '' group by term",
    "q_search_and": f"""with {WORDS_SQL}, {_TERM} select doc_id, page, count(*)::int as n_hits, array_to_string(list_sort(list(pos))[1:12], ',') as positions from terms where term in ('the', 'and', 'with') group by all having count(distinct term) = 3""",
    "q_phrase": f"with {WORDS_SQL}, {_TERM} select doc_id, page, pos from (select *, lead(term) over (partition by doc_id, page order by pos) as next from terms) where term = 'of' and next = 'the'",
    "q_fuzzy": """select p_partkey, tier from (select p_partkey, (case when starts_with(l, 're') then 0 when starts_with(i, 're') then 1 when regexp_matches(l, '(^|[^a-z0-9])re') then 2 when contains(l, 're') then 3
      when contains(i, 're') then 4 when regexp_matches(l, '[r].*[e]') then 5 end)::int as tier from (select p_partkey, lower(p_name) as l, regexp_replace(lower(p_name), '([a-z0-9])[a-z0-9]*[^a-z0-9]*', '\\1', 'g') as i from part)) where tier is not null""",
    "q_page_resolver": f"with {WORDS_SQL} select doc_id, (doc_id % 4)::int as page from (select doc_id, max(page) as n_pages from words group by doc_id) where doc_id % 4 between 1 and n_pages",
    "q_dedupe": "select doc_id, case when doc_id > first_id then first_id end as duplicate_of, n_copies from (select doc_id, min(doc_id) over (partition by sha256(text)) as first_id, count(*) over (partition by sha256(text)) as n_copies from documents)",
    "q_collection_digest": "with d as (select source, sha256(text) as sha from documents), r as (select source, sha[1:3] || sha256(string_agg(sha, '' order by sha)) as part from d group by source, sha[1:3]) select source, sha256(string_agg(part, '' order by part)) as digest from r group by source",
    "q_snapshot_diff": """with e as (select 'u' || user_id as path, event_id % 2 as half, max(event_id) - max(event_id) % 1000 as m from events group by all)
      select coalesce(a.path, b.path) as path, case when a.path is null then 'added' when b.path is null then 'removed' else 'modified' end as change
      from (select * from e where half = 0) a full join (select * from e where half = 1) b on a.path = b.path where a.path is null or b.path is null or a.m <> b.m""",
    "q_debounce": """with e as (select user_id as key, ts, (coalesce(ts - lag(ts) over (partition by user_id order by ts) >= interval 1 hour, true))::int as new from events),
      s as (select key, ts, sum(new) over (partition by key order by ts rows unbounded preceding) as burst from e) select key, min(ts) as first_ts, count(*) as n_events from s group by key, burst""",
    "q_memo_misses": "select doc_id, sha256(md5(text) || '|v1') as key from documents d where not exists (select 1 from documents m where m.doc_id % 3 <> 0 and m.text = d.text)",
    "q_prune": "select event_id as key, sum(event_id % 97 + 1) over (order by ts desc, event_id rows unbounded preceding) <= 100000 as kept from events",
    "q_plural": """select p_partkey as n, case when p_partkey % 10 = 1 and p_partkey % 100 <> 11 then 'one' when p_partkey % 10 between 2 and 4 and p_partkey % 100 not between 12 and 14 then 'few' else 'many' end as east_slavic,
      case when p_partkey = 1 then 'one' when p_partkey % 10 between 2 and 4 and p_partkey % 100 not between 12 and 14 then 'few' else 'many' end as polish,
      case when p_partkey = 0 then 'zero' when p_partkey = 1 then 'one' when p_partkey = 2 then 'two' when p_partkey % 100 between 3 and 10 then 'few' when p_partkey % 100 between 11 and 99 then 'many' else 'other' end as arabic,
      case when p_partkey = 1 then 'one' when p_partkey = 2 then 'two' else 'other' end as hebrew, case when p_partkey = 1 then 'one' else 'other' end as one from part""",
    "q_number_formats": f"select k, format('{{:,}}', n) as grouped, {_SECONDS} as seconds from (select o_orderkey as k, o_orderkey * o_custkey * 37 as n from orders)",
    "q_parse_size": """select p_partkey, asked, case p_partkey % 5 when 0 then p_size::bigint * 1024 when 1 then p_size::bigint * 1048576 when 2 then p_size::bigint * 1073741824 when 3 then p_size::bigint end as bytes
      from (select p_partkey, p_size, p_size || (['KB', ' m', 'GiB', '', ' apples'])[p_partkey % 5 + 1] as asked from part)""",
    "q_pdf_date": """select o_orderkey, case o_orderkey % 3 when 0 then strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S+02:00') when 1 then strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') else strftime(o_orderdate, 'D:%Y%m%d%H%M%S odd') end as iso from orders""",
    "q_findings": f"""with {WORDS_SQL}, meet as (select distinct w.doc_id, w.page, w.pos, w.x, w.w from words w join redactions r on w.doc_id = r.doc_id and w.page = r.page and w.x < r.x + r.w and r.x < w.x + w.w and w.y < r.y + r.h and r.y < w.y + w.h
        where (least(w.x + w.w, r.x + r.w) - greatest(w.x, r.x)) * (least(w.y + w.h, r.y + r.h) - greatest(w.y, r.y)) / (w.w * w.h) > 0.8),
      i as (select *, pos - row_number() over (partition by doc_id, page order by pos) as island from meet)
      select doc_id, page, min(pos) as first_pos, count(*) as n_tokens, round(max(x + w), 6) as x2 from i group by doc_id, page, island""",
    "q_bursts_by_type": "select event_type, date_trunc('day', ts)::timestamp as day, count(*) as n_events, round(sum(value), 4) as total from events group by all",
}
QUERIES = {k: v for k, v in globals().items() if k.startswith("q_")}
