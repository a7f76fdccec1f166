"""Scalar text functions as Column expressions; Arrow-batched UDFs only where no built-in expresses the measure."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words too common in statistical table titles to tell tables apart.
GENERIC_WORDS = (
    "total count index value amount share change number average annual monthly weekly quarterly other general male female both year period "
    "margin percent rate mean from with that this have been were they their"
).split()
# Words that are no evidence for a code.
UNGROUNDED_WORDS = (
    "total count index value amount share change number average annual monthly weekly quarterly other general male female persons population "
    "netherlands dutch classified with from that this have been more some than such when"
).split()
# English month names.
MONTHS = "january february march april may june july august september october november december".split()

_YEAR = r"((?:19|20)\d{2})"
#: An edge of a word of ASCII letters, digits and underscores, as RE2 has it: Java's own \b takes other letters for words too.
EDGE = r"(?:(?<![0-9A-Za-z_])(?=[0-9A-Za-z_])|(?<=[0-9A-Za-z_])(?![0-9A-Za-z_]))"


def processed(text: Column) -> Column:
    """Lower case, punctuation removed, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\w\s]", ""), r"\s+", " "))


def tokens(text: Column, pattern: str = r"\w+") -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({pattern})"), F.lit(1))


def without_words(words: Column, stop: list[str]) -> Column:
    return F.filter(words, lambda w: ~w.isin(stop))


def camel_words(name: Column) -> Column:
    """CamelCase as words, without a number at the end."""
    plain = F.regexp_replace(name, r"_\d+$", "")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"([a-z0-9])([A-Z])", "$1 $2"), r"([A-Z]+)([A-Z][a-z])", "$1 $2"))


def overlap(query: Column, label: Column) -> Column:
    """Share of the query's distinct tokens that the label has; 0 for a query without tokens."""
    q = F.array_distinct(query)
    return F.size(F.array_intersect(q, label)) / F.greatest(F.size(q), F.lit(1)).cast("double")


def grounded(label_tokens: Column, question: Column) -> Column:
    """Whether a meaningful token of the label is in the question; true if it has none."""
    meant = F.filter(label_tokens, lambda t: (F.length(t) >= 4) & ~t.isin(UNGROUNDED_WORDS))
    return (F.size(meant) == 0) | F.exists(meant, lambda t: F.contains(F.lower(question), t))


def uri_to_code(uri: Column) -> Column:
    return F.regexp_replace(uri, r"^.*[/#]", "")


def is_period_code(code: Column) -> Column:
    return code.rlike(r"^\d{4}(JJ|KW|MM)\d{2}$")


def is_time_dimension(name: Column, codes: Column) -> Column:
    """A dimension called period(s), or whose first five codes are all period codes."""
    return F.lower(name).isin("period", "periods", "perioden") | ((F.size(codes) > 0) & F.forall(F.slice(codes, 1, 5), is_period_code))


def period_codes(question: Column) -> Column:
    """Period codes that a question mentions: months, quarters, then ranges (of up to 20 years), pairs and single years;
    a month or quarter claims its year."""
    q = F.lower(question)
    every = lambda pattern, group=1: F.regexp_extract_all(q, F.lit(pattern), F.lit(group))
    made = lambda found, suffix: F.transform(found, lambda y: F.concat(y, F.lit(suffix)))
    months = [made(every(rf"\b{name}\s+{_YEAR}\b"), f"MM{i:02d}") for i, name in enumerate(MONTHS, 1)]
    quarters = [made(F.concat(every(rf"\bq{k}\s*{_YEAR}\b"), every(rf"\b{_YEAR}\s*q{k}\b")), f"KW{k:02d}") for k in range(1, 5)]
    exact = F.concat(*months, *quarters)
    claimed = F.transform(exact, lambda c: F.substring(c, 1, 4))
    range_ = rf"\b{_YEAR}\s*(?:[-–]|to)\s*{_YEAR}\b"
    pairs = F.arrays_zip(every(range_, 1).alias("a"), every(range_, 2).alias("b"))
    gap = lambda p: p["b"].cast("int") - p["a"].cast("int")
    spans = F.flatten(F.transform(F.filter(pairs, lambda p: (gap(p) > 0) & (gap(p) <= 20)), lambda p: F.transform(F.sequence(p["a"].cast("int"), p["b"].cast("int")), lambda y: y.cast("string"))))
    slash = rf"\b{_YEAR}/{_YEAR}\b"
    both = F.flatten(F.transform(F.arrays_zip(every(slash, 1).alias("a"), every(slash, 2).alias("b")), lambda p: F.array(p["a"], p["b"])))
    years = F.concat(spans, both, every(rf"\b{_YEAR}\b"))
    return F.array_distinct(F.concat(exact, made(F.filter(years, lambda y: ~F.array_contains(claimed, y)), "JJ00")))


def first_sentence(text: Column) -> Column:
    return F.split(text, r"\.")[0]


def expanded_label(preferred: Column, alternatives: Column) -> Column:
    """`pref (alt; alt)`, or the preferred label alone."""
    return F.when(F.size(alternatives) > 0, F.concat(preferred, F.lit(" ("), F.array_join(alternatives, "; "), F.lit(")"))).otherwise(preferred)


def truncated(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def stripped_response(text: Column) -> Column:
    """A model's answer without its thoughts and code fences."""
    plain = F.regexp_replace(text, r"(?s)<think>.*?</think>", "")
    return F.trim(F.regexp_replace(plain, r"```[a-zA-Z]*\n?|```", ""))


def json_answer(text: Column, field: str) -> Column:
    """A field of a JSON answer; empty if the text is no JSON or lacks it."""
    return F.coalesce(F.get_json_object(stripped_response(text), f"$.{field}"), F.lit(""))


def listed_ids(raw: Column) -> Column:
    """The first token of each line of a numbered list, upper case, in order."""
    lines = F.transform(F.split(raw, "\n"), lambda s: F.upper(F.regexp_extract(F.regexp_replace(F.trim(s), r"^\d+[.)]\s*", ""), r"^\S+", 0)))
    return F.array_distinct(F.filter(lines, lambda s: s != ""))


def prompt_lines(header: Column, items: Column) -> Column:
    """The header, and a line for each item."""
    return F.concat(header, F.lit("\n"), F.array_join(F.transform(items, lambda i: F.concat(F.lit("- "), i)), "\n"))


def table_ids(query: Column) -> Column:
    """Table ids in an expression or in SQL text."""
    return F.array_distinct(F.concat(F.regexp_extract_all(query, F.lit(r"(?i)\(VALUE\s+([A-Za-z0-9_]+)"), F.lit(1)), F.regexp_extract_all(query, F.lit(r"(?i)(?:FROM|JOIN)\s+['\"](?:[^'\"]*/)?([A-Za-z0-9_]+)\.parquet['\"]"), F.lit(1))))


def _lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bits."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    row = (1 << len(a)) - 1
    full = row
    for c in b:
        hit = row & masks.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def best_window_ratio(a: str | None, b: str | None) -> float | None:
    """0 to 100: the indel similarity of the shorter text and the best window of the longer, windows at its ends may be
    shorter. Two empty texts are alike, one is like nothing; a null gives a null."""
    if a is None or b is None:
        return None
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    m = len(short)
    if not m:
        return 100.0 if not long else 0.0
    windows = {long[max(0, i) : i + m] for i in range(1 - m, len(long))}
    return max(200.0 * _lcs(short, w) / (m + len(w)) for w in windows)


def partial_ratio(a: Column, b: Column) -> Column:
    """best_window_ratio() in Arrow batches."""

    def ratios(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([best_window_ratio(p, q) for p, q in zip(x, y, strict=True)], dtype="float64")

    return F.pandas_udf(ratios, "double")(a, b)


def near_equal(a: str | None, b: str | None, least: float = 0.95) -> bool | None:
    """Whether difflib's ratio is at least `least`; cheap upper bounds first."""
    if a is None or b is None:
        return None
    m = SequenceMatcher(None, a, b)
    return m.real_quick_ratio() >= least and m.quick_ratio() >= least and m.ratio() >= least


def close_match(a: Column, b: Column) -> Column:
    """near_equal() in Arrow batches."""

    def near(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([near_equal(p, q) for p, q in zip(x, y, strict=True)], dtype="object")

    return F.pandas_udf(near, "boolean")(a, b)
