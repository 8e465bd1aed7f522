"""Porter's suffix stripping (1980) as one expression, in Spark SQL or DuckDB SQL.

A word is [C](VC)^m[V] in runs of consonants and vowels, where y is a vowel after a consonant.
Each step looks for the longest of its endings that the word has, and rewrites it if what stands
before the ending is long enough. A step's result is bound once, as the variable of a
one-element array's lambda, so that the expression grows with the rules and not with their powers.
"""

from __future__ import annotations

from itertools import count

_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
#: What the stem before an ending must match.
_SOME, _ONE, _MORE = f"^({_C})?{_V}{_C}", f"^({_C})?{_V}{_C}({_V})?$", f"^({_C})?{_V}{_C}{_V}{_C}"
_VOWEL, _SHORT = f"^({_C})?[aeiouy]", f"^{_C}[aeiouy][^aeiouwxy]$"

# The endings of the published algorithm and what takes their place.
_PLURAL = [("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")]
_SECOND = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
]
_THIRD = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
_FOURTH = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


class _Dialect:
    """What the two engines write differently."""

    def __init__(self, spark: bool):
        self.spark, self.names = spark, count()

    def let(self, value: str, body) -> str:
        x = f"x{next(self.names)}"
        return f"element_at(transform(array({value}), {x} -> {body(x)}), 1)" if self.spark else f"list_transform([{value}], lambda {x}: {body(x)})[1]"

    def has(self, x: str, pattern: str) -> str:
        return f"({x} rlike '{pattern}')" if self.spark else f"regexp_matches({x}, '{pattern}')"

    def each(self, values: str, body) -> str:
        x = f"x{next(self.names)}"
        return f"transform({values}, {x} -> {body(x)})" if self.spark else f"list_transform({values}, lambda {x}: {body(x)})"

    def symbol(self, x: str) -> str:
        flag = "" if self.spark else ", 'g'"
        return f"lower(regexp_replace(regexp_replace({x}, '[^a-zA-Z0-9]+', '_'{flag}), '^_+|_+$', ''{flag}))"

    def words(self, x: str) -> str:
        return f"split({x}, '_')" if self.spark else f"string_split({x}, '_')"

    def joined(self, xs: str) -> str:
        return f"array_join({xs}, '_')" if self.spark else f"array_to_string({xs}, '_')"


def _cut(x: str, ending: str) -> str:
    return f"left({x}, length({x}) - {len(ending)})"


def _rules(d: _Dialect, x: str, rules: list[tuple[str, str]], least: str | None, also: dict[str, str] | None = None) -> str:
    """The longest ending that there is, rewritten if its stem matches ``least`` (and ``also``)."""
    arms = []
    for ending, new in sorted(rules, key=lambda r: -len(r[0])):
        stem = _cut(x, ending)
        tests = [d.has(stem, p) for p in (least, (also or {}).get(ending)) if p]
        arms.append(f"when {x} like '%{ending}' then " + (f"case when {' and '.join(tests)} then {stem} || '{new}' else {x} end" if tests else f"{stem} || '{new}'"))
    return f"case {' '.join(arms)} else {x} end"


def _past(d: _Dialect, x: str) -> str:
    """Past forms and -ing: gone where a vowel stands before, and the stem mended."""

    def mended(s: str) -> str:
        double = d.has(s, "(bb|cc|dd|ff|gg|hh|jj|kk|mm|nn|pp|qq|rr|tt|vv|ww|xx|yy)$")
        return f"case when {d.has(s, '(at|bl|iz)$')} then {s} || 'e' when {double} then left({s}, length({s}) - 1) when {d.has(s, _ONE)} and {d.has(s, _SHORT)} then {s} || 'e' else {s} end"

    arm = lambda e: f"when {x} like '%{e}' then case when {d.has(_cut(x, e), _VOWEL)} then {d.let(_cut(x, e), mended)} else {x} end"
    return f"case when {x} like '%eed' then case when {d.has(_cut(x, 'eed'), _SOME)} then left({x}, length({x}) - 1) else {x} end {arm('ed')} {arm('ing')} else {x} end"


def _last_e(d: _Dialect, x: str) -> str:
    s = _cut(x, "e")
    return f"case when {x} like '%e' and ({d.has(s, _MORE)} or {d.has(s, _ONE)} and not {d.has(s, _SHORT)}) then {s} else {x} end"


def porter_sql(word: str, spark: bool = True, d: _Dialect | None = None) -> str:
    """The stem of a lower-case word, as SQL; words of one or two characters stay."""
    d = d or _Dialect(spark)
    steps = [
        lambda x: _rules(d, x, _PLURAL, None),
        lambda x: _past(d, x),
        lambda x: f"case when {x} like '%y' and {d.has(_cut(x, 'y'), _VOWEL)} then {_cut(x, 'y')} || 'i' else {x} end",
        lambda x: _rules(d, x, _SECOND, _SOME),
        lambda x: _rules(d, x, _THIRD, _SOME),
        lambda x: _rules(d, x, [(e, "") for e in _FOURTH], _MORE, {"ion": "[st]$"}),
        lambda x: _last_e(d, x),
        lambda x: f"case when {x} like '%ll' and {d.has(_cut(x, 'l'), _MORE)} then {_cut(x, 'l')} else {x} end",
    ]

    def chain(k: int):
        return lambda x: d.let(steps[k](x), chain(k + 1)) if k + 1 < len(steps) else steps[k](x)

    return d.let(word, lambda w: f"case when length({w}) < 3 then {w} else {chain(0)(w)} end")


def symbol_sql(label: str, spark: bool = True) -> str:
    """A label as a symbol: runs of other characters than ASCII letters and digits become one line."""
    return _Dialect(spark).symbol(label)


def morphology_sql(label: str, spark: bool = True) -> str:
    """The words of a label's symbol, each stemmed; nouns in -acy count as the adjectives in -ate."""
    d = _Dialect(spark)
    plain = lambda w: f"case when {w} like '%acy' and length({w}) > 4 then left({w}, length({w}) - 2) || 'te' else {w} end"
    return d.joined(d.each(d.words(d.symbol(label)), lambda w: porter_sql(plain(w), spark, d)))
