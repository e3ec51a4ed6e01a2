"""Queries on tokens, languages, readability and text shapes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from dossier.functions import scripts, stopwords, text
from dossier.operators import ordered, quality
from dossier.operators.lineage import written
from dossier.sources.corpus import TOKENS_SQL, WORDS_SQL, table, tokens, words

_NORM = f"regexp_replace(lower(translate(text, '{text.FOLD_FROM}', '{text.FOLD_TO.replace(chr(39), chr(39) * 2)}')), '^[\\p{{P}}\\p{{S}}]+|[\\p{{P}}\\p{{S}}]+$', '', 'g')"
_GARBAGE = f"""(length(text) > 20 or regexp_matches(text, '{"|".join(f"({c}){{4}}" for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789#%&;:,=_äöüßéèêàçñóíáú")}|[$]{{4}}|[*]{{4}}|[.]{{4}}|[!]{{4}}|[|]{{4}}|[-]{{4}}')
  or length(regexp_replace(text, '[^\\p{{P}}\\p{{S}}\\p{{C}}]', '', 'g')) > 2
  or (length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')) >= 4 and (length(regexp_replace(lower(text), '[^{text.LATIN_VOWELS}]', '', 'g')) / length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')) < 0.1
    or length(regexp_replace(lower(text), '[^{text.LATIN_VOWELS}]', '', 'g')) / length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')) > 0.9)))"""


def _stopwords(spark, sf_dir):
    """The most frequent words of each language of the collection, counted once."""
    return written(stopwords.counted(table(spark, sf_dir, "documents")))


def q_stopwords(spark, sf_dir):
    return stopwords.counted(table(spark, sf_dir, "documents"))


def q_tokens(spark, sf_dir):
    docs = tokens(table(spark, sf_dir, "documents"))
    return docs.groupBy("doc_id").agg(F.count("*").alias("n_tokens"), F.sum(F.length("text")).alias("n_token_chars"))


def q_normalize(spark, sf_dir):
    docs = tokens(table(spark, sf_dir, "documents"))
    return docs.groupBy(text.normalized(F.col("text")).alias("token")).agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_docs"))


def q_stopword_ratio(spark, sf_dir):
    return quality.stopword_ratios(tokens(table(spark, sf_dir, "documents")), _stopwords(spark, sf_dir)).select("doc_id", "lang", F.round("ratio", 6).alias("ratio"))


def q_detect_language(spark, sf_dir):
    return quality.languages(tokens(table(spark, sf_dir, "documents")), _stopwords(spark, sf_dir)).select("doc_id", "language", "confidence")


#: What stands behind each text by its number, so that all scripts occur.
_SCRIPTS = ["", " Ж", " δ", " слово", " ελληνικά", " 漢字仮名", " かなカナ", " 한글말", " שלום", " देवनागरी"]


def _scripted(spark, sf_dir):
    """Whole texts, or every tenth letter of them, in turns, with much text of another script behind."""
    more = F.repeat(F.element_at(F.array(*map(F.lit, _SCRIPTS)), (F.col("doc_id") % len(_SCRIPTS) + 1).cast("int")), (F.length("text") % 400).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat("text", more).alias("text"))


def q_script(spark, sf_dir):
    docs = _scripted(spark, sf_dir)
    return docs.select("doc_id", scripts.script(F.col("text")).alias("script"), scripts.letters(F.col("text")).alias("n_letters"), scripts.stopwords_apply(F.col("text")).alias("judgeable"))


def q_declared_ratio(spark, sf_dir):
    """The best ratio of any language, or of two declared ones together."""
    return quality.declared_ratio(tokens(table(spark, sf_dir, "documents")), _stopwords(spark, sf_dir), ["en", "fr"]).select("doc_id", F.round("ratio", 6).alias("ratio"))


def q_characters(spark, sf_dir):
    """Words in han script as characters, with boxes in proportion."""
    rows = words(_scripted(spark, sf_dir))
    return scripts.characters(rows).groupBy("doc_id").agg(F.count("*").alias("n"), F.round(F.sum("w"), 4).alias("w"), F.sum("part").alias("parts"))


def q_language_codes(spark, sf_dir):
    asked = ["eng", "en-GB", "chi_sim", " FRA", "xx", "de_AT", "ru", ""]
    rows = table(spark, sf_dir, "part").select("p_partkey", F.element_at(F.array(*map(F.lit, asked)), (F.col("p_partkey") % len(asked) + 1).cast("int")).alias("asked"))
    return rows.select("p_partkey", scripts.language_code(F.col("asked")).alias("code"), scripts.language_name(scripts.language_code(F.col("asked"))).alias("name"), F.array_join(scripts.language_codes(F.array(F.col("asked"), F.lit("eng"), F.lit("fra"), F.lit("en"))), ",").alias("codes"))


def q_verdict_cases(spark, sf_dir):
    """Verdicts of pages with and without words, images and ink."""
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 7).alias("n"), (F.col("p_partkey") % 2 == 0).alias("image"), (F.col("p_partkey") % 3 == 0).alias("glyphs"), (F.col("p_size") / 1000).alias("ink"), (F.col("p_partkey") % 5 == 0).alias("pic"), (F.col("p_size") % 4).alias("signals"))
    return p.select("p_partkey", quality.final_verdict(F.col("n"), F.col("image"), F.col("glyphs"), F.col("ink"), F.col("pic"), F.col("signals")).alias("verdict"))


def q_garbage(spark, sf_dir):
    docs = tokens(table(spark, sf_dir, "documents"))
    return docs.groupBy("doc_id").agg(F.sum(text.is_garbage(F.col("text")).cast("int")).alias("n_garbage"), F.count("*").alias("n_tokens"))


def q_quality_verdict(spark, sf_dir):
    return quality.page_verdicts(words(table(spark, sf_dir, "documents")), _stopwords(spark, sf_dir)).select("doc_id", "page", "n_words", "n_signals", "verdict")


def q_embedded_text(spark, sf_dir):
    return quality.embedded_text_broken(table(spark, sf_dir, "documents"))


def q_redacted_shape(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.shape(F.col("text")).alias("shape"))


def q_slug(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.slug(F.col("text")).alias("slug"))


def q_natural_sort(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.concat(F.lit("doc"), F.col("p_partkey").cast("string"), F.lit(".pdf")).alias("name"))
    placed = ordered.running(parts.withColumn("key", text.natural_key(F.col("name"))), [F.col("key"), F.col("name")])
    return placed.select("name", F.col("_rank").cast("int").alias("place"))


def q_plain_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.plain(F.col("text")).alias("plain"))


def q_skeleton(spark, sf_dir):
    docs = tokens(table(spark, sf_dir, "documents"))
    return docs.groupBy(text.skeleton(F.col("text")).alias("skeleton")).agg(F.count("*").alias("n"))


def q_page_lines(spark, sf_dir):
    rows = words(table(spark, sf_dir, "documents"))
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda w: w["text"]), " ")
    return rows.groupBy("doc_id", "page", "line").agg(line.alias("line_text"))


def q_running_offsets(spark, sf_dir):
    before = Window.partitionBy("doc_id", "page").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return words(table(spark, sf_dir, "documents")).select("doc_id", "page", "pos", F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)).alias("offset"))


def q_order_pairs(spark, sf_dir):
    after = Window.partitionBy("doc_id").orderBy("pos")
    rows = tokens(table(spark, sf_dir, "documents")).select("doc_id", "pos", text.skeleton(F.col("text")).alias("a")).withColumn("b", F.lead("a").over(after)).where("b is not null")
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_pairs"), F.count_distinct("a", "b").alias("n_distinct_pairs"))


SKELETON_SQL = (
    "replace(replace(replace(translate(regexp_replace(translate(lower(text), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^0-9a-zÀ-￯]+', '', 'g'),"
    " '0123456789|!$@£', 'olzeasgtbgllsae'), 'rn', 'm'), 'vv', 'w'), 'cl', 'd')"
)
_STOPWORDS = stopwords.COUNTED_SQL.format(norm=_NORM)
_ALPHA = f"alpha as (select doc_id, {_NORM} as word from tokens where regexp_matches({_NORM}, '\\p{{L}}'))"
_RATIO = f"""{_ALPHA}, n as (select doc_id, count(*) as n from alpha group by doc_id),
hits as (select doc_id, lang, count(*) as hits from alpha join stopwords using (word) group by all), ratio as (select doc_id, lang, hits / n::double as ratio, n from hits join n using (doc_id))"""
_PLAIN = (
    r"regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?s)<!--.*?-->', ' ', 'g'), '[#>*_`]+', ' ', 'g'), '\[([^\]\n]+)\]\([^)\s]+\)', '\1', 'g'), '\s+', ' ', 'g')), '\s+([,.;:!?])', '\1', 'g')"
)
_SLUG = "regexp_replace(substring(regexp_replace(regexp_replace(translate(lower(replace(text, 'ß', 'ss')), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60), '-+$', '')"

_SCRIPTED = "select doc_id, text || repeat((" + str(_SCRIPTS) + ")[doc_id % " + str(len(_SCRIPTS)) + " + 1], (length(text) % 400)::int) as text from documents"

ORACLE = {
    "q_tokens": f"with {TOKENS_SQL} select doc_id, count(*) as n_tokens, sum(length(text))::bigint as n_token_chars from tokens group by doc_id",
    "q_normalize": f"with {TOKENS_SQL} select {_NORM} as token, count(*) as n, count(distinct doc_id) as n_docs from tokens group by 1",
    "q_stopword_ratio": f"with {TOKENS_SQL}, {_STOPWORDS}, {_RATIO} select doc_id, lang, round(ratio, 6) as ratio from ratio",
    "q_detect_language": f"""with {TOKENS_SQL}, {_STOPWORDS}, {_RATIO},
      r as (select *, row_number() over (partition by doc_id order by ratio desc, lang) as k, lead(ratio) over (partition by doc_id order by ratio desc, lang) as next from ratio)
      select d.doc_id, coalesce(lang, 'und') as language,
        coalesce(least(1.0::double, ratio / 0.2::double) * (0.35::double + 0.65::double * ((ratio - coalesce(next, 0.0::double)) / ratio)) * least(1.0::double, n / 40.0::double), 0.0::double) as confidence
      from (select distinct doc_id from tokens) d left join (select * from r where k = 1) r using (doc_id)""",
    "q_stopwords": f"with {TOKENS_SQL}, {_STOPWORDS} select lang, word from stopwords",
    "q_declared_ratio": f"""with {TOKENS_SQL}, {_STOPWORDS}, {_ALPHA}, n as (select doc_id, count(*) as n from alpha group by doc_id), l as (select lang, word from stopwords union select '+', word from stopwords where lang in ('en', 'fr'))
      select doc_id, round(max(hits / n::double), 6) as ratio from (select doc_id, lang, count(*) as hits from alpha join l using (word) group by all) join n using (doc_id) group by doc_id""",
    "q_script": f"""with s as ({_SCRIPTED}), c as (select doc_id, length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')) as n, {", ".join(f"length(regexp_replace(regexp_replace(text, '[^\\p{{L}}]', '', 'g'), '[^{scripts._class(r)}]', '', 'g')) as {name}" for name, r in {**scripts.RANGES, "kana": scripts.KANA_HANGUL}.items())} from s)
      select doc_id, case when n = 0 then 'latin' {" ".join(f"when {name} >= 0.85 * n then '{name}'" for name in scripts.RANGES)} else 'mixed' end as script, n as n_letters, n > 0 and latin + cyrillic + han - kana >= 0.5 * n as judgeable from c""",
    "q_characters": f"""with s as ({_SCRIPTED}), {WORDS_SQL.replace("from documents)", "from s)")}, k as (select *, case when length(text) > 1 and length(regexp_replace(regexp_replace(text, '[^\\p{{L}}]', '', 'g'), '[^{scripts._class(scripts.RANGES["han"])}]', '', 'g')) >= 0.85 * length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')) and regexp_matches(text, '\\p{{L}}') then length(text) else 1 end as c from words)
      select doc_id, sum(c)::bigint as n, round(sum(w), 4) as w, sum(c * (c - 1) // 2)::bigint as parts from k group by doc_id""",
    "q_language_codes": """with c as (select p_partkey, (['eng', 'en-GB', 'chi_sim', ' FRA', 'xx', 'de_AT', 'ru', ''])[p_partkey % 8 + 1] as a from part), d as (select p_partkey, case p_partkey % 8 when 0 then 'en' when 1 then 'en' when 2 then 'zh' when 3 then 'fr' when 5 then 'de' when 6 then 'ru' end as code from c)
      select p_partkey, code, case code when 'en' then 'English' when 'zh' then 'Chinese' when 'fr' then 'French' when 'de' then 'German' when 'ru' then 'Russian' end as name, case coalesce(code, 'en') when 'en' then 'en,fr' when 'fr' then 'fr,en' else code || ',en,fr' end as codes from d""",
    "q_verdict_cases": """select p_partkey, case when n = 0 then case when not image then case when glyphs then 'unreadable' else 'blank' end when ink < 0.005 then 'blank' when pic then 'pictorial' else 'unreadable' end when k >= 2 and n < 5 and pic then 'pictorial' when k >= 2 then 'suspect' else 'good' end as verdict
      from (select p_partkey, p_partkey % 7 as n, p_partkey % 2 = 0 as image, p_partkey % 3 = 0 as glyphs, p_size / 1000 as ink, p_partkey % 5 = 0 as pic, p_size % 4 as k from part)""",
    "q_garbage": f"with {TOKENS_SQL} select doc_id, sum(({_GARBAGE})::int)::bigint as n_garbage, count(*) as n_tokens from tokens group by doc_id",
    "q_quality_verdict": f"""with {WORDS_SQL}, {_STOPWORDS},
      w as (select doc_id, page, conf, text, {_GARBAGE} as bad, case when regexp_matches({_NORM}, '\\p{{L}}') then {_NORM} end as word from words),
      p as (select doc_id, page, count(*) as n, count(word) as alpha, median(conf) as mid, avg((conf < 60)::int) as low, avg(bad::int) as garbage, avg(length(word)) as mean_len, median(length(word)) as mid_len from w group by all),
      h as (select doc_id, page, max(c) as top from (select doc_id, page, lang, count(*) as c from w join stopwords using (word) group by all) group by all),
      s as (select *, (alpha >= 20 and coalesce(top, 0) / alpha < 0.1)::int + (mid < 70)::int + (low > 0.3)::int + (n >= 20 and garbage > 0.08)::int
        + (alpha >= 20 and (mean_len < 4.15 or mean_len > 6.25 or mid_len < 3 or mid_len > 6))::int as k from p left join h using (doc_id, page))
      select doc_id, page, n as n_words, k::int as n_signals, case when k >= 2 then 'suspect' else 'good' end as verdict from s""",
    "q_embedded_text": """select doc_id, length(text) as n_chars, length(regexp_replace(text, '[^\\x{FFFD}\\x{E000}-\\x{F8FF}]', '', 'g')) > 0.1 * length(text) as private_use,
      length(text) > 40 and length(regexp_replace(text, '[^ \\n\\t]', '', 'g')) < 0.05 * length(text) as few_spaces from documents""",
    "q_redacted_shape": "select doc_id, case when length(m) > 52 then substring(m, 1, 51) || '…' else m end as shape from (select doc_id, regexp_replace(text, '[\\p{L}\\p{N}]', '#', 'g') as m from documents)",
    "q_slug": f"select doc_id, case when s = '' then 'doc' when regexp_full_match(s, '(con|prn|aux|nul|com[0-9]|lpt[0-9])') then s || '-doc' else s end as slug from (select doc_id, {_SLUG} as s from documents)",
    "q_natural_sort": "select 'doc' || p_partkey || '.pdf' as name, row_number() over (order by p_partkey)::int as place from part",
    "q_plain_text": f"select doc_id, case when length(p) <= 240 then p else regexp_replace(substring(p, 1, 239), '\\s\\S*$', '') || '…' end as plain from (select doc_id, {_PLAIN} as p from documents)",
    "q_skeleton": f"with {TOKENS_SQL} select case when s = '' then '·' else s end as skeleton, count(*) as n from (select {SKELETON_SQL} as s from tokens) group by 1",
    "q_page_lines": f"with {WORDS_SQL} select doc_id, page, line, string_agg(text, ' ' order by pos) as line_text from words group by all",
    "q_running_offsets": f"with {WORDS_SQL} select doc_id, page, pos, coalesce(sum(length(text) + 1) over (partition by doc_id, page order by pos rows between unbounded preceding and 1 preceding), 0)::bigint as \"offset\" from words",
    "q_order_pairs": f"""with {TOKENS_SQL}, s as (select doc_id, pos, case when {SKELETON_SQL} = '' then '·' else {SKELETON_SQL} end as a from tokens),
      p as (select doc_id, a, lead(a) over (partition by doc_id order by pos) as b from s) select doc_id, count(*) as n_pairs, count(distinct (a, b)) as n_distinct_pairs from p where b is not null group by doc_id""",
}
QUERIES = {k: v for k, v in globals().items() if k.startswith("q_")}
