"""The flagship query: the heaviest concept pairs of the English documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import graph, text
from skein.plans.tables import TOKENS, table


def top_pairs(spark: SparkSession, sf_dir: str, n: int = 20) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("lang = 'en'")
    tokens = text.tokenize(text.dedup_segments(text.segment_text(docs)))
    return graph.cooccurrence_edges(tokens, ["doc_id", "seg"]).orderBy(F.desc("weight"), "src", "dst").limit(n)


QUERIES = {"flagship_top_pairs": top_pairs}
SQL = {
    "flagship_top_pairs": f"""with docs as (select * from documents where lang = 'en'), {TOKENS.replace("from documents)", "from docs)")},
        pairs as (select least(a, b) as src, greatest(a, b) as dst, w from (select token as a, unnest([lead(token, 1) over along, lead(token, 2) over along, lead(token, 3) over along]) as b, unnest([3, 2, 1]) as w
            from tokens window along as (partition by doc_id, seg order by pos)) where b is not null and a <> b)
        select src, dst, sum(w)::bigint as weight from pairs group by src, dst order by weight desc, src, dst limit 20"""
}
