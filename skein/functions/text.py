"""Column functions over text: cleaning, segments, tokens, slugs, cues."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.functions.words import NOISE, OVERLAP_STOP, STOP

#: A word's edge. \\b takes accented letters for parts of words in Java 17 and not in the SQL and
#: script engines whose results are to be met, so that edges are spelled out over ASCII.
EDGE = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"

#: What is no prose, in the order of removal. Fixed values.
ARTIFACTS = [
    r"```[\s\S]*?```",
    r"`[^`\n]{1,200}`",
    EDGE[0] + r"(?:https?|file|ftp)://\S+",
    r"(?:\.{0,2}/)?(?:[A-Za-z0-9._-]+/){2,}[A-Za-z0-9._-]+",
    "(?i)" + EDGE[0] + r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}" + EDGE[1],
    "(?i)" + EDGE[0] + r"[a-z][a-z0-9]*(?:_[a-z0-9]+)+" + EDGE[1],
    r"(?:\.|->)\s*[a-z][a-zA-Z0-9]*" + EDGE[1],
    r'"[^"\n]{1,80}"\s*:',
    r'"[a-zA-Z][a-zA-Z0-9_-]{0,30}"',
    r":\s*\d+(?:\.\d+)?" + EDGE[1],
]
#: Hard breaks, then ends of sentences that follow no capital or digit. Fixed values.
PARAGRAPH = r"\n\s*\n|\n\s*[-*•]\s+|\n\s*\d+[.)]\s+"
SENTENCE = r"(?<![A-Z0-9])[.!?]+(?=\s|$)"
TOKEN = r"[\p{L}\p{N}_]+"

#: Cues of attributed positions, of propositional and of figurative language. Fixed values.
ATTRIBUTION = r"(?i)\b(holds?|argues?|claims?|asserts?|maintains?|contends?|proposes?|denies|objects?|according to|on this view|the \w+ (view|position|account|objection))\b"
PROPOSITIONAL = r"(?i)\b(if\b.*\bthen|therefore|thus|hence|it follows|entails?|implies|necessary|sufficient|all\s+\w+\s+are|no\s+\w+\s+(is|are)|cannot be both|contradicts?|inconsistent)\b"
FIGURATIVE = r"(?i)\b(like a|as if|as though|sheds? light|in terms of|metaphor|analogy|resembles?|is a kind of dance|picture(s|d)? it)\b"
#: Marks of a preference. Fixed values.
PREFERENCE = r"(?i)\b(i (think|feel|believe|prefer|like|hate)|in my (view|opinion)|should be|ought to|better than|worse than|the best|the worst|obviously|clearly the)\b"


def trim_space(c: Column) -> Column:
    return F.btrim(c, F.lit(" \t\n\x0b\f\r"))  # what \s is; looks at the ends alone


def collapse(c: Column) -> Column:
    """Runs of white space as one blank. Most texts have none to replace, which a search shows."""
    one = F.transform(F.array(c), lambda t: F.when(t.rlike(r"\s\s|[\t\n\x0B\f\r]"), F.regexp_replace(t, r"\s+", " ")).otherwise(t))
    return trim_space(one[0])


#: For each artifact strings of which every match holds one.
MARKS = [["`"], ["`"], ["://"], ["/"], ["-"], ["_"], [".", "->"], ['"'], ['"'], [":"]]


def strip_artifacts(text: Column) -> Column:
    """TX-1. Code, links, paths, identifiers and JSON remains out, white space collapsed. A pattern
    is asked only where one of its marks stands, which is a plain search."""

    def without(pattern: str, marks: list[str]):
        def step(t: Column) -> Column:
            held = F.contains(t, F.lit(marks[0]))
            for mark in marks[1:]:
                held = held | F.contains(t, F.lit(mark))
            return F.when(held, F.regexp_replace(t, pattern, " ")).otherwise(t)

        return step

    one = F.array(text)  # a lambda's argument is evaluated once, however often it is named
    for pattern, marks in zip(ARTIFACTS, MARKS, strict=True):
        one = F.transform(one, without(pattern, marks))
    return collapse(one[0])


def segments(text: Column) -> Column:
    """TX-2. Array of sentence-like segments; segments never span paragraphs or list items."""
    parts = F.flatten(F.transform(F.split(text, PARAGRAPH, -1), lambda p: F.split(p, SENTENCE, -1)))
    return F.filter(F.transform(parts, trim_space), lambda s: s != "")


def segment_key(segment: Column) -> Column:
    """TX-3. What makes two segments the same."""
    return F.lower(collapse(segment))


def is_concept(token: Column) -> Column:
    """Not a stop word, closed-class word, numeral or single character."""
    number = (token >= "0") & (token < ":") & token.rlike(r"^[0-9]+$")  # only what begins with a digit is searched
    return (F.char_length(token) >= 2) & ~number & ~token.isin(*STOP, *NOISE)


def tokens(text: Column) -> Column:
    """TX-4. Lower-case concept words in order."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)), is_concept)


def content_words(text: Column) -> Column:
    """Distinct words of more than two characters, without the common ones."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: (F.char_length(w) > 2) & ~w.isin(*OVERLAP_STOP)))


def content_overlap(a: Column, b: Column) -> Column:
    """TX-16. Jaccard overlap of the content words; 0 if either has none."""
    left, right = content_words(a), content_words(b)
    return F.when((F.size(left) == 0) | (F.size(right) == 0), 0.0).otherwise(F.size(F.array_intersect(left, right)) / F.size(F.array_union(left, right)))


def slug(heading: Column, most: int = 72) -> Column:
    """TX-11. Lower-case ASCII letters and digits joined by hyphens; accents of Latin letters go."""
    plain = F.translate(F.lower(heading), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    return F.substring(F.regexp_replace(F.regexp_replace(plain, r"[^a-z0-9]+", "-"), r"^-+|-+$", ""), 1, most)


def n_tokens(text: Column) -> Column:
    """White-space tokens."""
    return F.size(F.filter(F.split(text, r"\s+", -1), lambda w: w != ""))


def compress(text: Column, most: int, share: float = 0.5) -> Column:
    """TX-17. The first half (rounded up, at least one) of the tokens of each paragraph; if more
    than ``most`` are left, the first ``most``."""
    words = lambda p: F.filter(F.split(p, r"\s+", -1), lambda w: w != "")
    cut = lambda w: F.slice(w, 1, F.greatest(F.lit(1), F.ceil(F.size(w) * share).cast("int")))
    paragraphs = F.filter(F.split(text, r"\n\s*\n", -1), lambda p: trim_space(p) != "")
    return F.array_join(F.slice(F.flatten(F.transform(paragraphs, lambda p: cut(words(p)))), 1, most), " ")


def finding_marks(text: Column) -> Column:
    """VE-13. Ids in ``[finding:<id>]`` marks."""
    return F.regexp_extract_all(text, F.lit(r"\[finding:([A-Za-z0-9_-]+)\]"), F.lit(1))


def sentences(text: Column) -> Column:
    """Parts after sentence enders before white space, or between blank lines."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+|\n{2,}", -1), trim_space), lambda s: s != "")
