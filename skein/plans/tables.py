"""The given tables, and the inputs of the operators that are derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.text import ARTIFACTS, EDGE
from skein.functions.words import NOISE, STOP
from skein.operators import text


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column | str) -> Column:
    """Doubles are compared at six decimals; the sum makes a negative zero positive."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def words(c: Column | str) -> Column:
    """An array as text."""
    return F.array_join(c, ",")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.dedup_segments(text.segment_text(table(spark, sf_dir, "documents")))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, seg, pos, token) of the deduplicated segments."""
    return text.tokenize(segments(spark, sf_dir))


def token_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, seg, tokens) of the deduplicated segments."""
    return text.token_lists(segments(spark, sf_dir))


# The same in DuckDB SQL. Fragments end without a comma and follow "with".
_STRIP = "text"
for _p in [*ARTIFACTS, r"\s+"]:
    for _edge in EDGE:
        _p = _p.replace(_edge, r"\b")  # RE2 has no look-around, and its \b is the ASCII one
    _STRIP = f"regexp_replace({_STRIP}, '{_p}', ' ', 'g')"
_TRIM = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"


def strip_sql(column: str) -> str:
    return _TRIM.format(_STRIP.replace("(text,", f"({column},", 1))


def trim_sql(expr: str) -> str:
    return _TRIM.format(expr)


def split_sql(column: str) -> str:
    """RE2 has no lookbehind: marks keep ends after capitals and digits out of the split."""
    guard = "regexp_replace(p, '([A-Z0-9])([.!?])', '\\1' || chr(1) || '\\2' || chr(2), 'g')"
    ends = f"regexp_split_to_array({guard}, '[.!?]+(?:\\s|$)')"
    parts = f"flatten(list_transform(regexp_split_to_array({column}, '\\n\\s*\\n|\\n\\s*[-*•]\\s+|\\n\\s*\\d+[.)]\\s+'), lambda p: {ends}))"
    clean = trim_sql("translate(s, chr(1) || chr(2), '')")
    return f"list_filter(list_transform({parts}, lambda s: {clean}), lambda s: s <> '')"


_LIST = lambda ws: ", ".join(f"'{w}'" for w in ws)
CONCEPT = "length({0}) >= 2 and not regexp_matches({0}, '^[0-9]+$') and {0} not in (" + _LIST(STOP + NOISE) + ")"
SEGMENTS = f"""
all_segments as (select doc_id, generate_subscripts(s, 1) - 1 as seg, unnest(s) as segment from (select doc_id, {split_sql("text")} as s from documents)),
segments as (select doc_id, seg, segment from all_segments
    qualify row_number() over (partition by lower({trim_sql("regexp_replace(segment, '\\s+', ' ', 'g')")}) order by doc_id, seg) = 1)"""
TOKENS = f"""{SEGMENTS},
token_lists as (select doc_id, seg, list_filter(regexp_extract_all(lower({strip_sql("segment")}), '[\\p{{L}}\\p{{N}}_]+'), lambda w: {CONCEPT.format("w")}) as ws from segments),
tokens as (select doc_id, seg, generate_subscripts(ws, 1) - 1 as pos, unnest(ws) as token from token_lists)"""
