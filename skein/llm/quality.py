"""Quality rules as a ledger of bits: every rule once, policies and ablations from the bits."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.runtime import schema_of

#: Characters counted as symbols.
SYMBOLS = "#*$%&|<>"
#: ASCII white space, which parts words.
BLANKS = b" \t\n\x0b\x0c\r"

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, n_alpha_words long"

#: A rule's bit is its place here; a rule is a condition on the measurements that holds where a
#: document fails. Add at the end only.
RULES = {
    "few_words": "n_words < 10",
    "repeated_windows": "100 * n_repeat_words > 20 * n_words",
    "many_symbols": "10 * n_symbols > 3 * n_words",
    "duplicate_lines": "10 * n_dup_lines > 3 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 15 * n_words",
    "upper_case": "2 * n_upper > n_words",
    "few_alphabetic": "2 * n_alpha_words < n_words",
}
BIT = {name: 1 << k for k, name in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    """A named, versioned choice of rules; a document is kept if it fails none of them."""

    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BIT[r] for r in self.rules)


BASE = Policy("base", 1, ("few_words", "repeated_windows"))
WEB = Policy("web", 1, (*BASE.rules, "many_symbols", "duplicate_lines", "short_words", "long_words", "upper_case"))


def repeated_words(words: list, window: int = 5) -> int:
    """Words that lie in a window of ``window`` words found twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    windows = list(zip(*(words[k:] for k in range(window))))
    if len(set(windows)) == n:
        return 0
    seen: dict[tuple, int] = {}
    repeats = set()
    for i, w in enumerate(windows):
        if (first := seen.setdefault(w, i)) != i:
            repeats.update((first, i))
    covered, end = 0, 0
    for i in sorted(repeats):
        covered += i + window - max(i, end)
        end = i + window
    return covered


def measure(text: str | None) -> tuple[int, ...]:
    """The measurements of one whole text, in the order of MEASURES. Null text has no words."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    kept = [x for x in text.split("\n") if x.encode().strip(BLANKS)]
    return (
        len(words),
        len(text) - sum(text.count(chr(c)) for c in BLANKS),
        sum(map(text.count, SYMBOLS)),
        len(kept) - len(set(kept)),
        repeated_words(words),
        len(kept),
        sum(map(bytes.isupper, words)),
        sum(map(str.isalpha, text.translate(_PUNCTUATION).split())) if words else 0,
    )


#: Marks go; white space beyond ASCII parts no words, and is no letter.
_PUNCTUATION = {ord(c): None for c in ".,;:!?'\"()-"} | {c: "\0" for c in range(0x3001) if chr(c).isspace() and c not in set(BLANKS)}


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, measurements, ``failed`` long): one row a document, bit k set where rule k fails.

    Words are runs without ASCII white space. Null text is empty and fails few_words. Rows that
    repeat an id each have a row; other columns of ``docs`` are left out; an empty table gives an
    empty ledger. Texts are measured whole, in the task that reads them; nothing is shuffled.
    """
    return _measured(docs.select(id_col, text_col), text_col, drop_text=True)


def keep(docs: DataFrame, policy: Policy, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that fail no rule of the policy, with the columns of ``docs``."""
    marked = _measured(docs.select([F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(docs.columns)]), f"_c{docs.columns.index(text_col)}")
    return apply_policy(marked, policy, "_kept").where("_kept").select([F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns)])


def _measured(docs: DataFrame, text_col: str, drop_text: bool = False) -> DataFrame:
    names, at = [x.split()[0] for x in MEASURES.split(", ")], docs.columns.index(text_col)
    held = [i for i in range(len(docs.columns)) if not (drop_text and i == at)]

    def run(batches):
        for batch in batches:
            rows = list(zip(*map(measure, batch.column(at).to_pylist()))) or [()] * len(names)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in held), *(pa.array(r, pa.int64()) for r in rows)], names=[*(batch.schema.names[i] for i in held), *names]
            )

    bits = sum((F.when(F.expr(rule), F.lit(BIT[name])).otherwise(0) for name, rule in RULES.items()), F.lit(0))
    return docs.mapInArrow(run, schema_of([docs.schema[i] for i in held], MEASURES)).withColumn("failed", bits.cast("long"))


def apply_policy(ledger_rows: DataFrame, policy: Policy, name: str = "kept") -> DataFrame:
    """The ledger with a boolean column: true where the document fails no rule of the policy."""
    return ledger_rows.withColumn(name, F.col("failed").bitwiseAND(F.lit(policy.mask)) == 0)


def ablation(ledger_rows: DataFrame, policies: list[Policy]) -> DataFrame:
    """(policy, version, rule, fails, fails_alone, kept_without): for each rule of each policy the
    documents that fail it, that fail it alone, and that a policy without it would keep.

    One pass: the ledger is counted by its bits, at most 2 to the number of rules rows, and the
    rest is bitwise sums over those counts.
    """
    spark = ledger_rows.sparkSession
    counts = ledger_rows.groupBy("failed").agg(F.count(F.lit(1)).alias("n"))
    terms = spark.createDataFrame(
        [(p.name, p.version, r, p.mask, BIT[r]) for p in policies for r in p.rules], "policy string, version int, rule string, mask long, bit long"
    )
    bits = lambda c: F.col("failed").bitwiseAND(c)
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    return (
        terms.join(F.broadcast(counts), F.lit(True), "left")  # both sides are bounded by the rules
        .groupBy("policy", "version", "rule")
        .agg(
            total(bits(F.col("bit")) != 0).alias("fails"),
            total(bits(F.col("mask")) == F.col("bit")).alias("fails_alone"),
            total(bits(F.col("mask").bitwiseAND(F.bitwise_not(F.col("bit")))) == 0).alias("kept_without"),
        )
    )
