"""Quality rules: a threshold table compiled into one Spark projection.

Statistics and verdicts are built-in expressions; no user function runs. The work of a row depends on
its own text alone, so nothing is shuffled.

Defined results: a null text is an empty one; an empty text has zero counts and fails ``words``. A ratio
whose denominator is zero is zero. Repeated rows are judged alike, columns of the input are kept, and
an input column that has the name of a statistic is replaced. An empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliolake.llm.common import bound_once, free_prefix, split_words, whole_text

#: Frequent function words of the corpus languages.
STOP_WORDS = (
    "the of and to in is that for it with as be on at by this from are was "
    "le la les de des du et un une en que qui est pour dans par sur au "
    "der die das und ist von zu den mit ein eine für auf dem nicht sich "
    "el los las y con una por su para se del lo como al"
).split()
SYMBOLS = "[^#*$%&|<>]+"
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """A row of the threshold table: ``least <= numerator / denominator <= most``.

    Texts of fewer than ``from_words`` words pass, because a ratio of so few says little.
    """

    name: str
    numerator: str
    denominator: str | None
    least: float | None = None
    most: float | None = None
    from_words: int = 0


#: Base rules decide ``base_failed``; the others are added to reach ``kept``.
BASE_RULES = (
    Rule("words", "n_words", None, least=10),
    Rule("repeated_words", "n_repeat_words", "n_words", most=0.20),
)
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", least=1.5, most=25.0),
    Rule("symbols", "n_symbols", "n_words", most=0.25),
    Rule("exclamations", "n_exclamations", "n_words", most=0.50),
    Rule("capitals", "n_capitals", "word_chars", most=0.50),
    Rule("letters", "n_letters", "word_chars", least=0.50),
    Rule("stop_words", "n_stop_words", "n_words", least=0.01, from_words=40),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", most=0.50),
)
STATISTICS = (
    "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_exclamations",
    "n_capitals", "n_letters", "n_stop_words",
)


def _only(text: Column, others: str) -> Column:
    """Number of characters left when the runs matching ``others`` are taken out."""
    return F.length(F.regexp_replace(text, others, ""))


def _repeat_words(words: Column) -> Column:
    """Words covered by windows of five words that are found twice or more.

    Windows are compared by a 64-bit hash within one text; only texts in which some hash repeats are sorted.
    """
    hashes = F.transform(
        F.sequence(F.lit(0), F.size(words) - WINDOW),
        lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(WINDOW))),
    )

    def places(windows: Column) -> Column:
        """Where windows start whose hash a neighbour in hash order shares."""
        twice = lambda e, k: (F.get(windows, k - 1)["h"] == e["h"]) | (F.get(windows, k + 1)["h"] == e["h"])
        return F.array_sort(F.array_compact(F.transform(windows, lambda e, k: F.when(twice(e, k), e["i"]))))

    def covered(starts: Column) -> Column:
        gaps = F.transform(starts, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, k + 1) - p, F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0), lambda total, n: total + n)

    def repeated(h: Column) -> Column:
        windows = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        counted = bound_once(windows, lambda w: bound_once(places(w), covered))
        return F.when(F.size(F.array_distinct(h)) < F.size(h), counted).otherwise(0)

    return F.when(F.size(words) >= WINDOW, bound_once(hashes, repeated)).otherwise(0)


def statistics(text: Column) -> Column:
    """A struct of every name in ``STATISTICS``; words and lines are taken once per row."""

    def counted(words: Column, lines: Column) -> Column:
        counts = {
            "n_words": F.size(words),
            "word_chars": F.length(F.array_join(words, "")),
            "n_symbols": _only(text, SYMBOLS),
            "n_lines": F.size(lines),
            "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
            "n_repeat_words": _repeat_words(words),
            "n_exclamations": _only(text, "[^!]+"),
            "n_capitals": _only(text, r"[^\p{Lu}]+"),
            "n_letters": _only(text, r"[^\p{L}]+"),
            "n_stop_words": F.size(F.filter(words, lambda w: w.isin(STOP_WORDS))),
        }
        return F.struct(*(counts[name].cast("long").alias(name) for name in STATISTICS))

    full_lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^ \t-\r]"))
    return bound_once(split_words(text), lambda words: bound_once(full_lines, lambda lines: counted(words, lines)))


def _passes(rule: Rule, row: Column) -> Column:
    value = row[rule.numerator].cast("double")
    if rule.denominator:
        value = F.coalesce(F.try_divide(value, row[rule.denominator].cast("double")), F.lit(0.0))
    passed = F.lit(True)
    if rule.least is not None:
        passed = passed & (value >= rule.least)
    if rule.most is not None:
        passed = passed & (value <= rule.most)
    return passed if not rule.from_words else passed | (row["n_words"] < rule.from_words)


def _all(rules, row: Column) -> Column:
    passed = F.lit(True)
    for rule in rules:
        passed = passed & _passes(rule, row)
    return passed


def judged(docs: DataFrame, base=BASE_RULES, rules=RULES) -> DataFrame:
    """Add the statistics, ``base_failed``, ``kept`` and ``failed_rules`` (names, in table order)."""
    added = (*STATISTICS, "base_failed", "kept", "failed_rules")
    own = [F.col(f"`{c}`") for c in docs.columns if c not in added]
    name = free_prefix(docs)
    rows, row = docs.select(*own, statistics(whole_text()).alias(name)), F.col(name)
    broken = F.array_compact(F.array(*(F.when(~_passes(r, row), F.lit(r.name)) for r in (*base, *rules))))
    return rows.select(
        *own,
        *(row[c].alias(c) for c in STATISTICS),
        (~_all(base, row)).alias("base_failed"),
        _all((*base, *rules), row).alias("kept"),
        broken.alias("failed_rules"),
    )


def kept_documents(docs: DataFrame, base=BASE_RULES, rules=RULES) -> DataFrame:
    """The documents that pass every rule, as they are."""
    return docs.filter(bound_once(statistics(whole_text()), lambda row: _all((*base, *rules), row)))
