"""Queries over text."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions import text as T
from skein.functions.words import OVERLAP_STOP
from skein.operators import text as O
from skein.plans.tables import CONCEPT, SEGMENTS, TOKENS, r6, segments, split_sql, strip_sql, table, tokens, trim_sql, words


def strip_artifacts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(T.strip_artifacts(F.col("text")).cast("binary")).alias("clean_md5"))


def segment_text(spark, sf):
    return O.segment_text(table(spark, sf, "documents")).select("doc_id", F.col("seg").cast("long").alias("seg"), "segment")


def dedup_segments(spark, sf):
    return segments(spark, sf).groupBy("doc_id").agg(F.count(F.lit(1)).alias("kept"), F.sum(F.char_length("segment")).alias("chars"))


def tokenize(spark, sf):
    return tokens(spark, sf).groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("docs"))


def _dictionary(toks):
    """Plurals of words that occur: token + s -> token."""
    vocabulary = toks.select("token").distinct()
    return vocabulary.select(F.concat("token", F.lit("s")).alias("surface"), F.col("token").alias("lemma"))


_DICTIONARY = "dictionary as (select distinct token || 's' as surface, token as lemma from tokens)"
_LEMMAS = f"lemmas as (select * from (select t.*, coalesce(d.lemma, token) as lemma from tokens t left join dictionary d on d.surface = t.token) where {CONCEPT.format('lemma')})"


def lemmatize(spark, sf):
    toks = tokens(spark, sf)
    return O.lemmatize(toks, _dictionary(toks)).groupBy("lemma").agg(F.count(F.lit(1)).alias("n"))


def surface_forms(spark, sf):
    toks = tokens(spark, sf)
    return O.surface_forms(O.lemmatize(toks, _dictionary(toks))).select("lemma", words("surfaces").alias("surfaces"))


def tfidf_single(spark, sf):
    return O.tfidf_single(tokens(spark, sf), ("doc_id",)).select("doc_id", "token", "tf", r6("tfidf").alias("tfidf"))


def tfidf_corpus(spark, sf):
    return O.tfidf_corpus(tokens(spark, sf)).select("doc_id", "token", "tf", "df", r6("tfidf").alias("tfidf"))


def _marked(spark, sf):
    """Documents with a heading before each line that begins with a vowel, as they have none."""
    text = F.regexp_replace(F.concat(F.lit("\n"), F.col("text")), r"\n([AEIOUaeiou])", "\n## $1")
    return table(spark, sf, "documents").select("doc_id", F.substring(text, 2, 1 << 30).alias("text"))


_MARKED = r"marked as (select doc_id, substr(regexp_replace(chr(10) || text, '\n([AEIOUaeiou])', chr(10) || '## \1', 'g'), 2) as text from documents)"
_WORDS = "len(list_filter(regexp_split_to_array({}, '\\s+'), lambda w: w <> ''))"


def _merge_sql(parts: str, keys: str, least: int) -> str:
    return f"""closing as (select *, ({_WORDS.format("part")} >= {least} or lead(place) over (partition by {keys} order by place) is null)::int as closes from {parts}),
grouped as (select *, coalesce(sum(closes) over (partition by {keys} order by place rows between unbounded preceding and 1 preceding), 0)::bigint as section from closing),
merged as (select {keys}, section, min(place) as first, string_agg(part, chr(10) || chr(10) order by place) as text from grouped group by {keys}, section)"""


_PARTS = f"""{_MARKED},
raw as (select * from (select doc_id, generate_subscripts(p, 1) - 1 as place, {trim_sql("unnest(p)")} as part
    from (select doc_id, string_split(replace(chr(10) || text, chr(10) || '## ', chr(1) || '## '), chr(1)) as p from marked)) where part <> ''),
placed as (select doc_id, greatest(place, coalesce(min(case when starts_with(part, '## ') then place end) over (partition by doc_id), 0)) as place, part from raw),
parts as (select doc_id, place, string_agg(part, chr(10) || chr(10) order by starts_with(part, '## '), part) as part from placed group by doc_id, place)"""
_SECTIONS = _PARTS + ",\n" + _merge_sql("parts", "doc_id", 32)


def _sections(spark, sf):
    return O.split_sections(_marked(spark, sf))


def split_sections(spark, sf):
    return _sections(spark, sf).select("doc_id", "section", F.md5(F.col("text").cast("binary")).alias("text_md5"), T.n_tokens(F.col("text")).cast("long").alias("n_tokens"))


def section_paragraphs(spark, sf):
    blank = _sections(spark, sf).withColumn("text", F.regexp_replace("text", "\n", "\n\n"))
    merged = O.section_paragraphs(blank.withColumnRenamed("section", "sec"), ["doc_id", "sec"])
    return merged.groupBy("doc_id", "sec").agg(F.count(F.lit(1)).alias("paragraphs"), F.max(T.n_tokens(F.col("text"))).cast("long").alias("longest"))


def section_slug(spark, sf):
    heads = _sections(spark, sf).select("doc_id", "section", F.substring(F.regexp_extract("text", r"(?m)^#* *(.*)$", 1), 1, 12).alias("heading"))
    return O.unique_slugs(heads, ["doc_id"], "section", "heading").select("doc_id", "section", "slug")


def position_of_segment(spark, sf):
    lines = _marked(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("place", "line"))
    return O.position_of_segment(lines, ["doc_id"], "place", "line").select("doc_id", F.col("place").cast("long").alias("place"), "position")


def source_table(spark, sf):
    lines = O.segment_text(table(spark, sf, "documents")).withColumn("id", F.format_string("%08d:%05d", "doc_id", "seg"))
    return O.source_table(lines, "segment", "id").select("source_id", words("ids").alias("ids"))


def material_signals(spark, sf):
    s = O.material_signals(table(spark, sf, "documents"))
    return s.select("doc_id", F.col("chars").cast("long").alias("chars"), F.col("sentences").cast("long").alias("sentences"), *[r6(c).alias(c) for c in ("question_ratio", "attribution", "propositional", "figurative")])


def classify_material(spark, sf):
    return O.classify_material(O.material_signals(table(spark, sf, "documents"))).select("doc_id", "kind", "formalizability", "path")


_SIGNALS = rf"""
ends as (select doc_id, text, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1) || '|\n{{2,}}'), lambda s: {trim_sql("s")}), lambda s: s <> '') as s from documents),
signals as (select doc_id, length(text) as chars, len(s) as sentences,
    len(list_filter(s, lambda x: ends_with(x, '?'))) / greatest(1, len(s)) as question_ratio,
    len(list_filter(s, lambda x: regexp_matches(x, '{T.ATTRIBUTION}'))) / greatest(1, len(s)) as attribution,
    len(list_filter(s, lambda x: regexp_matches(x, '{T.PROPOSITIONAL}'))) / greatest(1, len(s)) as propositional,
    len(list_filter(s, lambda x: regexp_matches(x, '{T.FIGURATIVE}'))) / greatest(1, len(s)) as figurative from ends)"""


def content_overlap(spark, sf):
    turns = table(spark, sf, "conversations")
    ask = turns.where("role = 'user'").select("conv_id", F.col("turn").alias("ask"), F.col("text").alias("a"))
    reply = turns.where("role = 'assistant'").select(F.col("conv_id").alias("c"), F.col("turn").alias("reply"), F.col("text").alias("b"))
    pairs = ask.join(reply, (F.col("conv_id") == F.col("c")) & (F.col("reply") == F.col("ask") + 1))
    return pairs.select("conv_id", "ask", r6(T.content_overlap(F.col("a"), F.col("b"))).alias("overlap"))


_CONTENT = "list_distinct(list_filter(regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+'), lambda w: length(w) > 2 and w not in (" + ", ".join(f"'{w}'" for w in OVERLAP_STOP) + ")))"


def deterministic_compress(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(T.compress(F.col("text"), 200).cast("binary")).alias("short_md5"), T.n_tokens(T.compress(F.col("text"), 200)).cast("long").alias("n"))


def _corpora(spark, sf):
    """One heading a benchmark item: its first sentence."""
    return table(spark, sf, "benchmark").select(F.format_string("corpus-%05d", "item_id").alias("corpus"), F.regexp_extract("text", r"^[^.\n]*", 0).alias("heading"))


def identify_corpus(spark, sf):
    return O.identify_corpus(table(spark, sf, "documents"), _corpora(spark, sf), "doc_id", "text").select("doc_id", "corpus")


def memory_namespace(spark, sf):
    found = O.identify_corpus(_marked(spark, sf).withColumn("text", F.regexp_replace("text", "(?m)^## ", "# ")), _corpora(spark, sf), "doc_id", "text")
    explicit = F.when(F.col("doc_id") % 50 == 0, F.concat(F.lit("given-"), F.col("doc_id").cast("string")))
    return found.select("doc_id", O.memory_namespace(explicit, F.col("corpus"), F.col("text"), F.col("doc_id").cast("string")).alias("namespace"))


_RULES = [("identity", "(?i)\\b(is the same|identical)\\b"), ("number", "[0-9]{2,}"), ("table", "\\|"), ("shout", "!!"), ("the", "(?i)\\bthe\\b"), ("mail", "@")]


def axiom_presence(spark, sf):
    rules = spark.createDataFrame(_RULES, "rule string, pattern string")
    return O.rule_presence(table(spark, sf, "documents"), rules, "doc_id", "text")


QUERIES = {
    "tx1_strip_artifacts": strip_artifacts, "tx2_segment_text": segment_text, "tx3_dedup_segments": dedup_segments, "tx4_tokenize": tokenize,
    "tx5_lemmatize": lemmatize, "tx6_surface_forms": surface_forms, "tx7_tfidf_single": tfidf_single, "tx8_tfidf_corpus": tfidf_corpus,
    "tx9_split_sections": split_sections, "tx10_section_paragraphs": section_paragraphs, "tx11_section_slug": section_slug,
    "tx12_position_of_segment": position_of_segment, "tx13_source_table": source_table, "tx14_material_signals": material_signals,
    "tx15_classify_material": classify_material, "tx16_content_overlap": content_overlap, "tx17_deterministic_compress": deterministic_compress,
    "tx18_identify_corpus": identify_corpus, "tx19_memory_namespace": memory_namespace, "tx20_axiom_presence": axiom_presence,
}

_MATCH = """corpora as (select format('corpus-{:05d}', item_id) as corpus, regexp_extract(text, '^[^.\\n]*') as heading from benchmark),
met as (select doc_id, min(corpus) as corpus from docs join corpora on length(heading) >= 12 and contains(docs.text, heading) group by doc_id)"""
_FORM = """case when chars < 600 then 'undetermined' when figurative >= 0.05 then 'argumentative' when attribution >= 0.12 then 'propositional'
    when attribution < 0.06 and propositional < 0.05 then 'narrative' else 'undetermined' end"""
_KIND = "case when chars < 600 and question_ratio >= 0.5 then 'question' when chars < 600 then 'instruction' else 'corpus' end"
_PLAIN = "translate(lower({}), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy')"
_SLUG = "substr(regexp_replace(regexp_replace(" + _PLAIN + ", '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, {})"
_SHORT = "list_slice(flatten(list_transform(list_filter(regexp_split_to_array(text, '\\n\\s*\\n'), lambda p: " + trim_sql("p") + " <> ''), lambda p: list_slice(list_filter(regexp_split_to_array(p, '\\s+'), lambda w: w <> ''), 1, greatest(1, ceil(" + _WORDS.format("p") + " * 0.5)::int)))), 1, 200)"

SQL = {
    "tx1_strip_artifacts": f"select doc_id, md5({strip_sql('text')}) as clean_md5 from documents",
    "tx2_segment_text": f"with {SEGMENTS} select doc_id, seg, segment from all_segments",
    "tx3_dedup_segments": f"with {SEGMENTS} select doc_id, count(*) as kept, sum(length(segment))::bigint as chars from segments group by doc_id",
    "tx4_tokenize": f"with {TOKENS} select token, count(*) as n, count(distinct doc_id) as docs from tokens group by token",
    "tx5_lemmatize": f"with {TOKENS}, {_DICTIONARY}, {_LEMMAS} select lemma, count(*) as n from lemmas group by lemma",
    "tx6_surface_forms": f"with {TOKENS}, {_DICTIONARY}, {_LEMMAS} select lemma, string_agg(distinct token, ',' order by token) as surfaces from lemmas group by lemma",
    "tx7_tfidf_single": f"with {TOKENS} select doc_id, token, count(*) as tf, round(count(*) * (1 + ln(0.5)), 6) as tfidf from tokens group by doc_id, token having count(*) * (1 + ln(0.5)) >= 0.1",
    "tx8_tfidf_corpus": f"""with {TOKENS}, tf as (select doc_id, token, count(*) as tf from tokens group by doc_id, token), df as (select token, count(*) as df from tf group by token),
        n as (select count(distinct doc_id) as n from tokens) select doc_id, token, tf, df, round(tf * (1 + ln(n / (1 + df))), 6) + 0.0 as tfidf from tf join df using (token), n""",
    "tx9_split_sections": f"with {_SECTIONS} select doc_id, section, md5(text) as text_md5, {_WORDS.format('text')}::bigint as n_tokens from merged",
    "tx10_section_paragraphs": f"""with {_SECTIONS}, praw as (select * from (select doc_id, section as sec, generate_subscripts(p, 1) - 1 as place, {trim_sql("unnest(p)")} as part
        from (select doc_id, section, regexp_split_to_array(replace(text, chr(10), chr(10) || chr(10)), '\\n\\s*\\n') as p from merged)) where part <> ''),
        {_merge_sql("praw", "doc_id, sec", 12).replace("closing", "pclosing").replace("grouped", "pgrouped").replace("merged", "pmerged")}
        select doc_id, sec, count(*) as paragraphs, max({_WORDS.format("text")})::bigint as longest from pmerged group by doc_id, sec""",
    "tx11_section_slug": f"""with {_SECTIONS}, h as (select doc_id, section, substr(regexp_extract(text, '^#* *([^\\n]*)', 1), 1, 12) as heading from merged),
        b as (select doc_id, section, {_SLUG.format("heading", 72)} as s0, row_number() over (partition by doc_id order by section) as n from h),
        c as (select *, case when s0 = '' then 'section-' || n else s0 end as s from b), d as (select *, row_number() over (partition by doc_id, s order by section) as k from c)
        select doc_id, section, case when k = 1 then s else s || '-' || k end as slug from d""",
    "tx12_position_of_segment": f"""with {_MARKED}, l as (select doc_id, generate_subscripts(p, 1) - 1 as place, unnest(p) as line from (select doc_id, string_split(text, chr(10)) as p from marked)),
        q as (select *, last_value(case when regexp_matches(line, '^## ') then regexp_replace(line, '^## +', '') end ignore nulls) over (partition by doc_id order by place rows between unbounded preceding and current row) as position from l)
        select doc_id, place, position from q where not regexp_matches(line, '^#')""",
    "tx13_source_table": f"with {SEGMENTS} select sha256(segment) as source_id, string_agg(format('{{:08d}}:{{:05d}}', doc_id, seg), ',' order by doc_id, seg) as ids from all_segments group by segment",
    "tx14_material_signals": f"with {_SIGNALS} select doc_id, chars, sentences, round(question_ratio, 6) as question_ratio, round(attribution, 6) as attribution, round(propositional, 6) as propositional, round(figurative, 6) as figurative from signals",
    "tx15_classify_material": f"""with {_SIGNALS}, k as (select doc_id, {_KIND} as kind, {_FORM} as formalizability from signals)
        select doc_id, kind, formalizability, case when kind = 'question' then 'build-corpus-first' when kind = 'instruction' then 'no-analysis' when formalizability = 'argumentative' then 'evidential' else 'formal-verification' end as path from k""",
    "tx16_content_overlap": f"""with p as (select a.conv_id, a.turn as ask, {_CONTENT.format("a.text")} as x, {_CONTENT.format("b.text")} as y from conversations a join conversations b on a.conv_id = b.conv_id and b.turn = a.turn + 1 where a.role = 'user' and b.role = 'assistant')
        select conv_id, ask, case when len(x) = 0 or len(y) = 0 then 0.0 else round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 6) end as overlap from p""",
    "tx17_deterministic_compress": f"select doc_id, md5(array_to_string({_SHORT}, ' ')) as short_md5, len({_SHORT})::bigint as n from documents",
    "tx18_identify_corpus": f"with docs as (select doc_id, text from documents), {_MATCH} select docs.doc_id, corpus from docs left join met using (doc_id)",
    "tx19_memory_namespace": f"""with {_MARKED}, docs as (select doc_id, regexp_replace(text, '(?m)^## ', '# ', 'g') as text from marked), {_MATCH},
        h as (select docs.*, corpus, regexp_extract(text, '(?m)^# +([^\\n]+)$', 1) as heading from docs left join met using (doc_id))
        select doc_id, coalesce(case when doc_id % 50 = 0 then 'given-' || doc_id end, corpus, case when length(heading) >= 12 then {_SLUG.format("heading", 60)} end, 'session:' || doc_id) as namespace from h""",
    "tx20_axiom_presence": "select distinct doc_id, rule from documents, (values " + ", ".join(f"('{a}', '{b}')" for a, b in _RULES) + ") r(rule, pattern) where regexp_matches(text, pattern)",
}
