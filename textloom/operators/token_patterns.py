"""Curated patterns over tokens: a table of labels with scopes and of patterns, one JSON object each, and the spans that they find.

A pattern is a list of tests, one for each token, with an optional count. Tests read the text or the lower-cased text (a value, or
``IN``, ``NOT_IN``, ``REGEX``), the shape, or a flag (``LIKE_NUM``, ``LIKE_URL``, ``LIKE_EMAIL``, ``IS_PUNCT``, ``SPACY``: a blank follows).
"""

from __future__ import annotations

import json
import re
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import SPAN
from .repair import is_address

SCOPES = ("tokens", "rest_of_sentence", "abstract", "abstract_or_sentence")
#: The labels of the cleaning rules and their scopes.
CLEANING_LABELS = {
    "url": "tokens", "email": "tokens", "doi": "tokens", "latex": "tokens", "abstract_label": "tokens", "footer": "rest_of_sentence",
    "event_header": "tokens", "review_header": "tokens", "download_stamp": "tokens", "copyright": "rest_of_sentence", "catalogue_record": "abstract",
    "letter": "abstract", "citation_record": "abstract", "citation_line": "abstract_or_sentence", "thesis_notes": "rest_of_sentence",
    "web_scrape": "abstract", "encoded_link": "tokens", "exam_spam": "abstract",
}
#: The mark of patterns that count at a text's start only, and the label that may stand before them.
START_ID, LEADING_LABEL = "start", "abstract_label"

_TOKEN = re.compile(r"(?:https?://|www\.)\S*[\w/]|[\w.+-]+@[\w-]+(?:\.[\w-]+)+|10\.\d{4,9}/\S+|(?:e\.g\.|i\.e\.|et al\.|cf\.|vs\.|pp\.|Pp\.|Dr\.|Fig\.|No\.)|\d+(?:[.,]\d+)*|[^\W_]+(?:['’-][^\W_]+)*|[^\w\s]|_")
_NUMBERS = set("zero one two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty hundred thousand million".split())


@dataclass(frozen=True)
class Token:
    text: str
    start: int
    end: int
    blank: bool

    @property
    def lower(self) -> str:
        return self.text.lower()

    @property
    def shape(self) -> str:
        """``X``, ``x`` and ``d`` for capitals, small letters and digits; of a run of one kind four at most."""
        kinds = "".join("X" if c.isupper() else "x" if c.islower() else "d" if c.isdigit() else c for c in self.text)
        return re.sub(r"(.)\1{4,}", lambda m: m[1] * 4, kinds)


def tokens_of(text: str) -> list[Token]:
    return [Token(m[0], m.start(), m.end(), text[m.end() : m.end() + 1].isspace()) for m in _TOKEN.finditer(text)]


FLAGS: dict[str, Callable[[Token], bool]] = {
    "LIKE_NUM": lambda t: t.text.replace(",", "").replace(".", "").replace("/", "").isdigit() or t.lower in _NUMBERS,
    "LIKE_URL": lambda t: "@" not in t.text and not t.text.startswith("10.") and is_address(t.text),
    "LIKE_EMAIL": lambda t: "@" in t.text and is_address(t.text),
    "IS_PUNCT": lambda t: not any(c.isalnum() or c.isspace() or c in "$£€+<=>^`|~" for c in t.text),
    "SPACY": lambda t: t.blank,
}
VALUES: dict[str, Callable[[Token], str]] = {"TEXT": lambda t: t.text, "ORTH": lambda t: t.text, "LOWER": lambda t: t.lower, "SHAPE": lambda t: t.shape}


def _value_test(name: str, wanted) -> Callable[[Token], bool]:
    read = VALUES[name]
    if isinstance(wanted, str):
        return lambda t: read(t) == wanted
    tests = []
    for kind, value in wanted.items():
        if kind == "IN":
            tests.append(lambda t, v=frozenset(value): read(t) in v)
        elif kind == "NOT_IN":
            tests.append(lambda t, v=frozenset(value): read(t) not in v)
        elif kind == "REGEX":
            tests.append(lambda t, r=re.compile(value): r.search(read(t)) is not None)
        else:
            raise ValueError(f"unknown test {kind}")
    return lambda t: all(test(t) for test in tests)


def _counts(op: str | None) -> tuple[int, int]:
    many = 1 << 30
    known = {None: (1, 1), "?": (0, 1), "*": (0, many), "+": (1, many)}
    if op in known:
        return known[op]
    if m := re.fullmatch(r"\{(\d+)(,(\d*))?\}", op):
        low = int(m[1])
        return low, low if m[2] is None else int(m[3]) if m[3] else many
    raise ValueError(f"unknown count {op}")


class TokenPattern:
    def __init__(self, label: str, pattern: list[dict], id: str | None = None):
        self.label, self.start_only = label, id == START_ID
        self.elements = []
        for element in pattern:
            tests = [_value_test(k, v) if k in VALUES else (lambda t, f=FLAGS[k], want=v: f(t) is want) for k, v in element.items() if k != "OP"]
            self.elements.append((lambda t, tests=tuple(tests): all(test(t) for test in tests), *_counts(element.get("OP"))))
        if not any(low for _, low, _ in self.elements):
            raise ValueError(f"a pattern of {label} matches nothing")
        first = pattern[0].get("LOWER")
        #: Where the first token must be one of some words, only they are tried.
        self.first = None if self.elements[0][1] == 0 else {first} if isinstance(first, str) else set(first["IN"]) if isinstance(first, dict) and "IN" in first else None

    def longest(self, tokens: list[Token], start: int) -> int:
        """The end of the longest match from ``start``, or -1."""
        at = {start}
        for test, low, high in self.elements:
            after = {p for p in at if low == 0}
            for p in at:
                n = 0
                while n < high and p + n < len(tokens) and test(tokens[p + n]):
                    n += 1
                    if n >= low:
                        after.add(p + n)
            at = after
            if not at:
                return -1
        return max(at)


class PatternSet:
    """Labels with their scopes, and patterns that have one of them."""

    def __init__(self, labels: dict[str, str], patterns: list[TokenPattern]):
        if wrong := sorted({s for s in labels.values() if s not in SCOPES} | {p.label for p in patterns if p.label not in labels}):
            raise ValueError(f"unknown scopes or labels: {', '.join(wrong)}")
        self.labels, self.by_word, self.others = labels, defaultdict(list), []
        for p in patterns:
            for word in p.first or ():
                self.by_word[word].append(p)
            if p.first is None:
                self.others.append(p)

    def spans(self, text: str) -> list[dict]:
        """Matches in order; of those that overlap the first longest stays. Start-only patterns count at the start or right after its label."""
        tokens = tokens_of(text)
        found = []
        for i, token in enumerate(tokens):
            for p in (*self.by_word.get(token.lower, ()), *self.others):
                end = p.longest(tokens, i)
                if end > i:
                    found.append((i, end, p))
        leading = max((end for i, end, p in found if i == 0 and p.label == LEADING_LABEL), default=0)
        allowed = [(i, end, p.label) for i, end, p in found if not p.start_only or i in (0, leading)]
        taken, kept = set(), []
        for i, end, label in sorted(allowed, key=lambda x: (x[0] - x[1], x[0])):
            if not taken & set(range(i, end)):
                taken |= set(range(i, end))
                kept.append((i, end, label))
        return [{"start": tokens[i].start, "end": tokens[end - 1].end, "label": label, "scope": self.labels[label]} for i, end, label in sorted(kept)]


def load_patterns(lines: list[str], labels: dict[str, str] = CLEANING_LABELS) -> PatternSet:
    """Patterns from curated lines, one JSON object each, and the declared scope of every label."""
    rows = [json.loads(x) for x in lines if x.strip()]
    return PatternSet(labels, [TokenPattern(r["label"], r["pattern"], r.get("id")) for r in rows])


def token_pattern_spans(text: Column, patterns: PatternSet) -> Column:
    """The spans of ``patterns``, as ``find_removals`` takes them. The set is compiled once for each task."""
    @F.pandas_udf(SPAN)
    def find(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: patterns.spans(t or ""))

    return find(text)
