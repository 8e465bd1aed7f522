"""Text operators: segments, tokens, term weights, sections, sources, material."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.operators.storage import written


def segment_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """TX-2. (id, ``seg``, ``segment``): one row a segment, in order from 0. Null text has none."""
    return docs.select(id_col, F.posexplode(T.segments(F.col(text_col))).alias("seg", "segment"))


def dedup_segments(segments: DataFrame, order: tuple[str, ...] = ("doc_id", "seg")) -> DataFrame:
    """TX-3. The first occurrence of each segment. A minimum by key, not a window: partial sums
    keep a segment that is everywhere from landing in one task."""
    kept = segments.groupBy(T.segment_key(F.col("segment")).alias("_key")).agg(F.min(F.struct(*order, "segment")).alias("_first"))
    return kept.select("_first.*")


def tokenize(segments: DataFrame, keys: tuple[str, ...] = ("doc_id", "seg")) -> DataFrame:
    """TX-4. (keys, ``pos``, ``token``) of the cleaned segments."""
    return segments.select(*keys, F.posexplode(T.tokens(T.strip_artifacts(F.col("segment")))).alias("pos", "token"))


def token_lists(segments: DataFrame, keys: tuple[str, ...] = ("doc_id", "seg")) -> DataFrame:
    """TX-4. (keys, ``tokens``): the same as one array a segment, in order."""
    return segments.select(*keys, T.tokens(T.strip_artifacts(F.col("segment"))).alias("tokens"))


def lemmatize(tokens: DataFrame, dictionary: DataFrame) -> DataFrame:
    """TX-5. ``lemma``: the shortest (then first) lemma that the dictionary (surface, lemma) has,
    else the token itself; lemmas that are no concepts go."""
    best = dictionary.groupBy("surface").agg(F.min(F.struct(F.char_length("lemma").alias("n"), F.col("lemma").alias("w"))).alias("best"))
    joined = tokens.join(best, tokens["token"] == best["surface"], "left").select(*tokens.columns, F.coalesce("best.w", "token").alias("lemma"))
    return joined.where(T.is_concept(F.col("lemma")))


def surface_forms(lemmas: DataFrame) -> DataFrame:
    """TX-6. (``lemma``, ``surfaces``): the forms in which a lemma occurs."""
    return lemmas.groupBy("lemma").agg(F.sort_array(F.collect_set("token")).alias("surfaces"))


def tfidf_single(tokens: DataFrame, doc: tuple[str, ...], floor: float = 0.1) -> DataFrame:
    """TX-7. Term weight with a document as its own corpus: tf (1 + ln(1/2)), below ``floor`` gone."""
    return tokens.groupBy(*doc, "token").agg(F.count(F.lit(1)).alias("tf")).withColumn("tfidf", F.col("tf") * (1 + F.log(F.lit(0.5)))).where(F.col("tfidf") >= floor)


def tfidf_corpus(tokens: DataFrame, doc: str = "doc_id") -> DataFrame:
    """TX-8. Term weight against all documents: tf (1 + ln(N / (1 + df)))."""
    tf = written(tokens.groupBy(doc, "token").agg(F.count(F.lit(1)).alias("tf")), "tf")
    df = tf.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    n = tf.agg(F.count_distinct(doc)).first()[0]
    return tf.join(df, "token").select(doc, "token", "tf", "df", (F.col("tf") * (1 + F.log(F.lit(float(n)) / (1 + F.col("df"))))).alias("tfidf"))


def merge_short(parts: DataFrame, keys: list[str], order: str, text: str, least: int) -> DataFrame:
    """TX-9, TX-10. Parts under ``least`` tokens join the next one that is long enough; the last
    part takes what is left. (keys, ``section`` from 0, ``first`` place, ``text`` joined by a
    blank line)."""
    along = Window.partitionBy(*keys).orderBy(order)
    closes = (T.n_tokens(F.col(text)) >= least) | F.lead(order).over(along).isNull()
    marked = parts.withColumn("_closes", closes.cast("int"))
    section = F.coalesce(F.sum("_closes").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return (
        marked.withColumn("section", section)
        .groupBy(*keys, "section")
        .agg(F.min(order).alias("first"), F.array_sort(F.collect_list(F.struct(order, text))).alias("_all"))
        .select(*keys, "section", "first", F.array_join(F.transform("_all", lambda x: x[text]), "\n\n").alias("text"))
    )


def split_sections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 32, heading: str = "## ") -> DataFrame:
    """TX-9. Sections that begin at a heading line; what stands before the first joins it, unless it
    has a heading of a higher level (of two marks or more) of its own."""
    marked = F.regexp_replace(F.concat(F.lit("\n"), F.col(text_col)), f"\n(?={heading})", "\u0001")
    raw = docs.select(id_col, F.posexplode(F.split(marked, "\u0001", -1)).alias("place", "part")).withColumn("part", T.trim_space(F.col("part"))).where("part <> ''")
    first = F.min(F.when(F.col("part").startswith(heading), F.col("place"))).over(Window.partitionBy(id_col))
    level = len(heading) - len(heading.lstrip("#"))
    own = F.col("part").rlike(f"(?m)^#{{2,{level - 1}}}[ \\t]+\\S") if level > 2 else F.lit(False)
    joined = raw.withColumn("place", F.when(own & ~F.col("part").startswith(heading), F.col("place")).otherwise(F.greatest("place", F.coalesce(first, F.lit(0))))).groupBy(id_col, "place").agg(F.array_sort(F.collect_list(F.struct(F.col("part").startswith(heading).alias("h"), "part"))).alias("a"))
    parts = joined.select(id_col, "place", F.array_join(F.transform("a", lambda x: x["part"]), "\n\n").alias("part"))
    return merge_short(parts, [id_col], "place", "part", least)


def section_paragraphs(sections: DataFrame, keys: list[str], text_col: str = "text", least: int = 12) -> DataFrame:
    """TX-10. The same rule for the paragraphs of sections."""
    raw = sections.select(*keys, F.posexplode(F.split(text_col, r"\n\s*\n", -1)).alias("place", "part")).withColumn("part", T.trim_space(F.col("part"))).where("part <> ''")
    return merge_short(raw, keys, "place", "part", least)


def unique_slugs(headings: DataFrame, keys: list[str], order: str, heading: str) -> DataFrame:
    """TX-11. ``slug`` with -2, -3, … where a document has one twice; section-n where empty."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    base = headings.withColumn("_n", n).withColumn("_base", F.when(T.slug(F.col(heading)) == "", F.concat(F.lit("section-"), F.col("_n").cast("string"))).otherwise(T.slug(F.col(heading))))
    k = F.row_number().over(Window.partitionBy(*keys, "_base").orderBy(order))
    return base.withColumn("slug", F.when(k == 1, F.col("_base")).otherwise(F.concat("_base", F.lit("-"), k.cast("string")))).drop("_n", "_base")


def position_of_segment(segments: DataFrame, keys: list[str], order: str, text: str) -> DataFrame:
    """TX-12. ``position``: the last ## heading before a segment; headings themselves are left out."""
    head = F.when(F.col(text).rlike("^## "), F.regexp_replace(text, "^## +", ""))
    back = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return segments.withColumn("position", F.last(head, True).over(back)).where(~F.col(text).rlike("^#"))


def source_table(segments: DataFrame, text: str, id_col: str) -> DataFrame:
    """TX-13. Each distinct text under a hash with the ids of its segments."""
    return segments.groupBy(text).agg(F.sort_array(F.collect_list(id_col)).alias("ids")).select(F.sha2(F.col(text), 256).alias("source_id"), text, "ids")


def material_signals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """TX-14. Characters, sentences, and shares of sentences with a question or a cue."""
    s = F.col("s")
    share = lambda cond: F.size(F.filter(s, cond)) / F.greatest(F.lit(1), F.size(s))
    return docs.select(id_col, F.char_length(text_col).alias("chars"), T.sentences(F.col(text_col)).alias("s")).select(
        id_col, "chars", F.size(s).alias("sentences"), share(lambda x: x.endswith("?")).alias("question_ratio"),
        share(lambda x: x.rlike(T.ATTRIBUTION)).alias("attribution"), share(lambda x: x.rlike(T.PROPOSITIONAL)).alias("propositional"), share(lambda x: x.rlike(T.FIGURATIVE)).alias("figurative"),
    )


def classify_material(signals: DataFrame, least_chars: int = 600) -> DataFrame:
    """TX-15. ``kind``, ``formalizability`` and ``path``, by the thresholds in their order."""
    short = F.col("chars") < least_chars
    kind = F.when(short & (F.col("question_ratio") >= 0.5), "question").when(short, "instruction").otherwise("corpus")
    form = (
        F.when(short, "undetermined")
        .when(F.col("figurative") >= 0.05, "argumentative")
        .when(F.col("attribution") >= 0.12, "propositional")
        .when((F.col("attribution") < 0.06) & (F.col("propositional") < 0.05), "narrative")
        .otherwise("undetermined")
    )
    path = F.when(F.col("kind") == "question", "build-corpus-first").when(F.col("kind") == "instruction", "no-analysis").when(F.col("formalizability") == "argumentative", "evidential").otherwise("formal-verification")
    return signals.withColumn("kind", kind).withColumn("formalizability", form).withColumn("path", path)


def identify_corpus(texts: DataFrame, headings: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """TX-18. ``corpus``: the first by name whose heading of 12 characters or more stands in the
    text. Headings are a reference table, one row a corpus; the smaller side is sent to the other
    only under Spark's own broadcast threshold."""
    usable = headings.where(F.char_length("heading") >= 12)
    met = texts.select(id_col, text_col).join(usable, F.contains(F.col(text_col), F.col("heading"))).groupBy(id_col).agg(F.min("corpus").alias("corpus"))
    return texts.join(met, id_col, "left")


def memory_namespace(explicit: Column, corpus: Column, text: Column, session: Column) -> Column:
    """TX-19. The namespace given, else the corpus, else the slug of the first # heading of 12
    characters or more, else the session."""
    heading = F.regexp_extract(text, r"(?m)^# +(.+)$", 1)
    titled = F.when(F.char_length(heading) >= 12, T.slug(heading, 60))
    return F.coalesce(explicit, corpus, titled, F.concat(F.lit("session:"), session))


def rule_presence(texts: DataFrame, rules: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """TX-20. (id, ``rule``) where a pattern of the rule table (rule, pattern) is found."""
    return texts.select(id_col, text_col).join(rules, F.regexp_like(F.col(text_col), F.col("pattern"))).select(id_col, "rule").distinct()
