"""License scan: ordered signature rules behind a keyword prefilter.

Rules are matched on a copy of the text in which every gap is one space: white space, line breaks and the comment
marks that begin a line (``#``, ``//``, ``*``, ``;``, ``--``, ``%``, ``<!--``), so it does not matter where a notice is
wrapped or what it is commented with. Spans are told in the text itself. One pass of an Aho-Corasick automaton over
that copy finds the keywords that occur; only rules whose keyword does are tried. Detections are resolved in rule order: one that lies inside an accepted detection is
suppressed. What is left gives the labels and a score, 1 minus the product of the detections' doubts, where
each label counts once with its surest rule.

Base phrases are found by words: runs of digits, a-z and characters beyond ASCII, after A-Z are lower-cased.
A base phrase stands wherever its words follow each other, whatever stands between them, and its label is
always kept.

Every row is worked on alone, in Arrow batches; nothing is shuffled, and memory is bounded by a batch.

Defined results: null and empty texts have no words, no labels and score 0. Repeated rows give the same
rows again. Other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from foliolake.llm.license_rules import rule_table
from foliolake.llm.words import find_words

#: Phrases whose label every scan reports.
BASE = (
    ("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"),
)
BASE_CONFIDENCE = 0.6
_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:] = True
_GAP = r"[\x00-\x2f\x3a-\x60\x7b-\x7f]"
_WORD = r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]"


@cache
def _compiled():
    """Rules, base patterns and the automaton, built once per process."""
    rules = [(r, re.compile(r.pattern)) for r in rule_table()]
    base = [
        (label, phrase.split()[0], re.compile(rf"(?<!{_WORD})" + rf"{_GAP}+".join(phrase.split()) + rf"(?!{_WORD})"))
        for phrase, label in BASE
    ]
    wanted: dict[str, tuple[list[int], list[int]]] = {}
    for number, (rule, _) in enumerate(rules):
        for keyword in rule.keyword.split("|"):
            wanted.setdefault(keyword, ([], []))[0].append(number)
    for number, (_, first, _) in enumerate(base):
        wanted.setdefault(first, ([], []))[1].append(number)
    automaton = ahocorasick.Automaton()
    for keyword, numbers in wanted.items():
        automaton.add_word(keyword, numbers)
    automaton.make_automaton()
    return rules, base, automaton


_MARKS = r"(?:(?:#+|//+!?|/?\*+/?|;+|--+|%+|<!--|-->|\.\\\"|dnl|rem)(?=\s|$))?"
#: What is read as one space: white space of two or more characters or other than a space, and commented line breaks.
_JOINED = re.compile(rf"(?:\s*\n\s*{_MARKS}\s*|^\s*{_MARKS}\s+|\s*-->\s*$|\s{{2,}}|[^\S ])+")


class Collapsed:
    """A text with its gaps as single spaces, and the way back to its places."""

    def __init__(self, text: str):
        self.source, self.text = text, _JOINED.sub(" ", text)
        self._gaps = None

    def _place(self, at: int) -> int:
        if self._gaps is None:
            spans = np.array([m.span() for m in _JOINED.finditer(self.source)], np.int64).reshape(-1, 2)
            removed = np.cumsum(spans[:, 1] - spans[:, 0] - 1)
            # Where each gap's space stands in the copy, and how much was left out up to and with it.
            self._gaps = spans[:, 0] - (removed - (spans[:, 1] - spans[:, 0] - 1)), removed
        before = int(np.searchsorted(self._gaps[0], at, side="left"))
        return at + (int(self._gaps[1][before - 1]) if before else 0)

    def span(self, start: int, end: int) -> tuple[int, int]:
        """The span of the text that a nonempty span of the copy stands for."""
        return self._place(start), self._place(end - 1) + 1


def detections(text: str, numbers) -> list[tuple[int, int, str, float]]:
    """(start, end, label, confidence) of the rules ``numbers``, without those inside an earlier rule's."""
    rules = _compiled()[0]
    accepted: list[tuple[int, int, str, float]] = []
    starts, reach = np.zeros(0, int), np.zeros(0, int)  # accepted starts in order, and the farthest end so far
    for number in sorted(numbers):
        rule, pattern = rules[number]
        spans = np.array([m.span() for m in pattern.finditer(text)], int).reshape(-1, 2)
        before = np.searchsorted(starts, spans[:, 0], side="right")
        inside = np.concatenate(([-1], reach))[before] >= spans[:, 1]
        if len(new := spans[~inside]):
            accepted += [(int(a), int(b), rule.label, rule.confidence) for a, b in new]
            ordered = sorted((a, b) for a, b, _, _ in accepted)
            starts = np.array([a for a, _ in ordered])
            reach = np.maximum.accumulate([b for _, b in ordered])
    return sorted(accepted)


def scan_text(text: str | None) -> tuple[list[tuple[int, int, str, float]], list[tuple[int, str]]]:
    """Detections, and base places as (first character, label), of one text."""
    text = (text or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    _, base, automaton = _compiled()
    copy = Collapsed(text)
    numbers, phrases = set(), set()
    for _, (rules, own) in automaton.iter(copy.text):
        numbers.update(rules)
        phrases.update(own)
    places = [(m.start(), base[k][0]) for k in sorted(phrases) for m in base[k][2].finditer(text)]
    found = [(*copy.span(a, b), label, sure) for a, b, label, sure in detections(copy.text, numbers)]
    return found, sorted(places)


_WORD_OF_TEXT = re.compile(rf"{_WORD}+")


def _row(text: str | None):
    """Base count, first and last word, base labels, labels, score and detections of a text."""
    found, places = scan_text(text)
    if not found and not places:
        return 0, None, None, "", "", 0.0, []
    lower = (text or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    first = last = None
    if places:
        first = sum(1 for _ in _WORD_OF_TEXT.finditer(lower[: places[0][0]]))
        last = first + sum(1 for _ in _WORD_OF_TEXT.finditer(lower[places[0][0] : places[-1][0]]))
    base = sorted({label for _, label in places})
    sure = dict.fromkeys(base, BASE_CONFIDENCE)
    for _, _, label, confidence in found:
        sure[label] = max(sure.get(label, 0.0), confidence)
    doubt = 1.0
    for confidence in sure.values():
        doubt *= 1 - confidence
    spans = [{"start": a, "end": b, "label": label, "confidence": c} for a, b, label, c in found]
    return len(places), first, last, ",".join(base), ",".join(sorted(sure)), 1 - doubt, spans


SCHEMA = (
    "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, "
    "labels string, score double, detections array<struct<start:int,end:int,label:string,confidence:double>>"
)
_KINDS = (
    pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(),
    pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.string()), ("confidence", pa.float64())])),
)
#: Bytes of text whose words are counted at once.
SLICE = 4 << 20


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = np.cumsum([len(t) if (t := x.as_buffer()) else 0 for x in batch.column("text")])
        low = 0
        while low < batch.num_rows:
            high = max(low + 1, int(np.searchsorted(sizes, (sizes[low - 1] if low else 0) + SLICE)))
            part = batch.slice(low, high - low)
            texts = part.column("text")
            counts = np.diff(find_words(texts, lower=True, is_word=_IS_WORD).first)
            columns = list(zip(*(_row(t.as_py()) for t in texts)))
            yield pa.record_batch(
                [part.column("doc_id").cast(pa.int64()), pa.array(counts, pa.int64()),
                 *(pa.array(c, kind) for c, kind in zip(columns, _KINDS))],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"],
            )
            low = high


def scanned(docs: DataFrame) -> DataFrame:
    """Words, base places, labels, score and detections (character spans) of every document."""
    return docs.select("doc_id", "text").mapInArrow(_scan, SCHEMA)
