"""The subpackage's registered queries: each applies its operator to its whole table."""

from __future__ import annotations

import uuid

from dossier.llm.ann import nearest
from dossier.llm.common import shared_folder, table
from dossier.llm.fingerprint import compared_with_next
from dossier.llm.html_text import extract_text
from dossier.llm.line_dedup import repeated_units
from dossier.llm.mixing import mix_sources
from dossier.llm.near_dedup import near_duplicates
from dossier.llm.packing import pack_documents
from dossier.llm.quality import score_quality
from dossier.llm.sharding import shard_documents
from dossier.llm.substring_dedup import remove_repeats


def op1_near_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)


def op2_fingerprints(spark, sf_dir):
    return compared_with_next(table(spark, sf_dir, "documents"))


#: Where the public vocabulary files are; a parameter of every query that needs tokens.
TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_packing(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer=tokenizer_path())


def op4_html_text(spark, sf_dir):
    return extract_text(table(spark, sf_dir, "pages"))


def op5_sharding(spark, sf_dir):
    maps = f"{shared_folder(spark)}/shard-maps-{uuid.uuid4().hex}"  # new documents, new map
    return shard_documents(table(spark, sf_dir, "documents"), shards=8, maps=maps)


def op6_substring_dedup(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents"), length=400)


def op7_mixing(spark, sf_dir):
    return mix_sources(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark, sf_dir):
    return repeated_units(table(spark, sf_dir, "documents"))


def op9_neighbours(spark, sf_dir):
    return nearest(table(spark, sf_dir, "embeddings"))


def op10_quality(spark, sf_dir):
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_near_dedup, op2_fingerprints, op3_packing, op4_html_text, op5_sharding, op6_substring_dedup, op7_mixing, op8_line_dedup, op9_neighbours, op10_quality)}

ORACLE: dict[str, str] = {
    "op7_mixing": r"""
with d as (
  select doc_id, source, md5('mix:' || doc_id::varchar) as turn,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size
  from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as weight,
             row_number() over (order by source nulls last) as rank from s),
o as (select *, row_number() over (order by 3 * source_size / weight, rank) as rank_by from w),
l as (select *, ((select sum(source_size) from o) - 3 * coalesce((select sum(p.source_size) from o p where p.rank_by < o.rank_by), 0))::double
             / (select sum(p.weight) from o p where p.rank_by >= o.rank_by) as level from o),
k as (select min(rank_by) as first_open from l where 3 * source_size / weight >= level),
t as (select source, source_size, case when source_size = 0 then 0.0 when rank_by < first_open then (3 * source_size)::double
             else weight * (select level from l where rank_by = first_open) end as target from l, k),
q as (select d.doc_id, d.size, t.source_size, t.target, round(t.target)::bigint as budget,
             sum(d.size) over (partition by d.source order by d.turn, d.size rows between unbounded preceding and current row) - d.size as start
      from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target,
       (greatest(0, least(budget - start, size)) + greatest(0, least(budget - start - source_size, size))
        + greatest(0, least(budget - start - 2 * source_size, size)))::bigint as taken,
       case when target > 0 then (start + size) / target end as finish
from q""",
}
