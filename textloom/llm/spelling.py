"""Spelling variants: words one error apart, found with forward and backward minimal acyclic automata.

A word with one error keeps its first half or the rest exactly. The vocabulary is dealt by these halves: forward by a word's first
code points, backward by its last, once for each half length that words one code point shorter or longer have. Of each share of the
vocabulary a task builds a minimal acyclic automaton, backward ones of the reversed words; its states number the words (a perfect hash), so
what is known of a word is an array at its number. Each word follows its own half exactly and completes the other with one error. What both
directions find is made distinct by one aggregation.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches, join_salted, materialise

LEAST_LENGTH = 6
LEAST_COUNT = 5
RATIO = 5
#: One occurrence in so many, by its hash, loses a code point.
DAMAGED = 199
RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: Words that a task counts before it passes counts on; words of a share, and of one automaton.
HELD_WORDS = 200_000
MOST_SHARE = 50_000
CHUNK = 20_000


def observed_words(doc_id: int | None, text: str | None, damaged: int = DAMAGED) -> Counter:
    """Words of a text with their counts, some losing a code point. Runs lie within Latin-1, whose ``bytes.lower`` changes only A-Z."""
    raw, out = Counter(RUN.findall(text or "")), Counter()
    head = b"" if doc_id is None else b"%d" % doc_id
    for run, n in raw.items():
        plain = run.encode("latin-1").lower()
        word = plain.decode("latin-1")
        h = zlib.crc32(head + b":" + (plain if plain.isascii() else word.encode()))
        if h % damaged == 0:
            k = h % len(word)
            word = word[:k] + word[k + 1 :]
        out[word] += n
    return out


def vocabulary(documents: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words of at least ``least_length`` code points and ``least_count`` occurrences. Tasks add up before they shuffle."""

    def run(batches):
        held = Counter()

        def batch():
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for rows in batches:
            for doc_id, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
                for word, n in observed_words(doc_id, text).items():
                    if len(word) >= least_length:
                        held[word] += n
            if len(held) > HELD_WORDS:
                yield batch()
        yield batch()

    counted = bounded_batches(documents).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


class Automaton:
    """A minimal acyclic automaton of distinct words, given in ascending order; words are numbered in that order.

    A state is a dictionary of arcs, code point to (state, number of the branch's first word less the state's own); END marks where a
    word ends. Equal states are one: a state is registered, once no word will change it, under its arcs.
    """

    END = ""

    def __init__(self, words: list[str]):
        self.states, self._register, self._size = [{}], {}, {}
        path, before = [0], ""  # the states of the word added last, none of them registered
        for word in words:
            shared = 0
            limit = min(len(word), len(before))
            while shared < limit and word[shared] == before[shared]:
                shared += 1
            self._close(path, before, shared)
            for c in word[shared:]:
                self.states.append({})
                self.states[path[-1]][c] = len(self.states) - 1
                path.append(len(self.states) - 1)
            self.states[path[-1]][self.END] = -1
            before = word
        self._close(path, before, 0)
        self.root = self._number(0)
        self.n_states = 1 + len(self._register)
        del self._register, self._size

    def _number(self, state: int) -> dict:
        """Gives the arcs of a finished state the numbers of the words before each."""
        arcs, n = self.states[state], 0
        numbered = {}
        if self.END in arcs:
            numbered[self.END], n = 0, 1
        for c, target in arcs.items():  # in ascending order, as words came
            if c != self.END:
                numbered[c] = (target, n)
                n += self._size[target]
        self.states[state] = numbered
        self._size[state] = n
        return numbered

    def _close(self, path: list[int], word: str, depth: int) -> None:
        """Registers the states of ``word`` below ``depth``, the lowest first."""
        while len(path) > depth + 1:
            state = path.pop()
            key = tuple(self.states[state].items())
            same = self._register.get(key)
            if same is None:
                self._register[key] = state
                self._number(state)
            else:
                self.states[path[-1]][word[len(path) - 1]] = same
                if state == len(self.states) - 1:
                    self.states.pop()

    def follow(self, arcs: dict, word: str, number: int = 0):
        """(arcs, number) after ``word``, or None."""
        states = self.states
        for c in word:
            arc = arcs.get(c)
            if arc is None:
                return None
            arcs, number = states[arc[0]], number + arc[1]
        return arcs, number

    def number(self, word: str) -> int | None:
        end = self.follow(self.root, word)
        return end[1] if end and self.END in end[0] else None

    def one_error(self, half: str, rest: str) -> set[int]:
        """Numbers of the words that start with ``half`` and go on as ``rest`` with one code point inserted, deleted or replaced."""
        at = self.follow(self.root, half)
        found = set()
        if at is None:
            return found
        arcs, number = at
        states, follow, END = self.states, self.follow, self.END
        for i in range(len(rest) + 1):
            here = rest[i] if i < len(rest) else None
            after = rest[i + 1 :]
            if here is not None:
                end = follow(arcs, after, number)  # the code point is missing
                if end and END in end[0]:
                    found.add(end[1])
            for c, arc in arcs.items():
                if c == END:
                    continue
                target, n = states[arc[0]], number + arc[1]
                end = follow(target, rest[i:], n)  # c is inserted
                if end and END in end[0]:
                    found.add(end[1])
                if here is not None and c != here:
                    end = follow(target, after, n)  # c replaces it
                    if end and END in end[0]:
                        found.add(end[1])
            if here is None or here not in arcs:
                break
            target, n = arcs[here]
            arcs, number = states[target], number + n
        return found


def exact_part(length: int, backward: bool) -> int:
    """How many code points of a word of this length have to match exactly: its first half, or all the rest."""
    return length - length // 2 if backward else length // 2


def _shares(words: DataFrame) -> DataFrame:
    """(backward, half, part, path, n, asks): each word, reversed if backward, in every share where a word that it is near to asks, and where it asks.

    A word of length L is found by words of lengths L-1 to L+1, whose halves have one of two lengths. Shares with more than ``MOST_SHARE``
    words are cut by hash into parts, and each part of those who ask meets each part of the listed words.
    """
    length = F.length("word")

    def rows(backward: bool):
        half = (lambda n: n - F.floor(n / 2)) if backward else (lambda n: F.floor(n / 2))
        path = F.reverse("word") if backward else F.col("word")
        sizes = F.array_distinct(F.array(*(half(length + d).cast("int") for d in (-1, 0, 1))))
        return words.select(F.lit(backward).alias("backward"), path.alias("path"), "n", half(length).cast("int").alias("own"), F.explode(sizes).alias("size")).withColumn(
            "half", F.expr("substring(path, 1, size)")
        )

    every = rows(False).unionByName(rows(True)).select("backward", "half", "path", "n", (F.col("own") == F.col("size")).alias("asks"))
    large = every.groupBy("backward", "half").agg(F.ceil(F.count("*") / MOST_SHARE).alias("parts")).where("parts > 1")
    known = join_salted(every.withColumn("_spread", F.xxhash64("path")), large, ["backward", "half"], "_spread", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    known = known.withColumn("own", F.pmod(F.xxhash64("path"), F.col("parts")))
    parts, own = F.col("parts"), F.col("own")
    each = F.sequence(F.lit(0).cast("long"), parts - 1)
    listed = F.transform(each, lambda k: own * parts + k)
    asking = F.when(F.col("asks"), F.transform(each, lambda k: k * parts + own)).otherwise(F.array().cast("array<long>"))
    dealt = known.withColumn("part", F.explode(F.array_distinct(F.concat(listed, asking))))
    return dealt.select("backward", "half", "part", "path", "n", (F.col("asks") & (F.col("part") % parts == own)).alias("asks"), (F.floor(F.col("part") / parts) == own).alias("listed"))


def _chunks(batches):
    """(backward, rows) of whole shares of one direction, part and half length, as many as make a chunk."""
    key, rows, share = None, [], []
    for batch in batches:
        for row in batch.to_pylist():
            now = (row["backward"], row["part"], row["half"])
            if now != key:
                if key is not None:
                    rows += share if len(share) > 1 else []  # a word that is alone has no one near
                    if now[:2] != key[:2] or len(now[2]) != len(key[2]) or len(rows) >= CHUNK:
                        if rows:
                            yield key[0], rows
                        rows = []
                key, share = now, []
            share.append(row)
    rows += share if len(share) > 1 else []
    if rows:
        yield key[0], rows


def _search(batches):
    for backward, rows in _chunks(batches):
        known = dict(sorted((r["path"], r["n"]) for r in rows if r["listed"]))
        words, counts = list(known), list(known.values())
        automaton = Automaton(words)
        out = ([], [], [])
        for row in rows:
            if row["asks"]:
                path, size = row["path"], len(row["half"])
                for k in automaton.one_error(path[:size], path[size:]):
                    for column, value in zip(out, (path[::-1] if backward else path, words[k][::-1] if backward else words[k], counts[k])):
                        column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.string(), pa.int64()))], ["word", "near", "near_n"])


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, near_n): all ordered pairs of ``words`` (word, n), distinct and of at least two code points, that one error separates."""
    dealt = _shares(words).repartition("backward", "half", "part").sortWithinPartitions("backward", "part", F.length("half"), "half", "path")
    found = dealt.mapInArrow(_search, "word string, near string, near_n long")
    return found.groupBy("word", "near").agg(F.first("near_n").alias("near_n"))


def roots(forms: DataFrame, label: str = "roots", most_rounds: int = 40) -> DataFrame:
    """(word, root): from each word of (word, form) along the forms to the last. Each round doubles the way that a word has gone."""
    way = materialise(forms.select("word", F.col("form").alias("root")), label)
    for _ in range(most_rounds):
        ahead = way.select(F.col("word").alias("root"), F.col("root").alias("_on"))
        moved = way.join(ahead, "root", "left")
        way = materialise(moved.select("word", F.coalesce("_on", "root").alias("root"), F.col("_on").isNotNull().alias("_moved")), label)
        if way.where("_moved").isEmpty():
            return way.drop("_moved")
        way = way.drop("_moved")
    raise RuntimeError("forms go round")


def spelling_variants(documents: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of the texts that is long and frequent enough.

    Near: exactly one code point inserted, deleted or replaced. form: the near word of largest n, the least in code-point order of several, if
    its n is at least ``ratio`` times the word's; else null. root: the last of the forms from the word on; a word without form is its own.

    Null and empty texts have no words, texts of any length count whole; a null doc_id counts as an empty one in the hash that damages words.
    Rows that repeat count each. An empty table gives no rows; columns beside doc_id and text take no part.
    """
    words = materialise(vocabulary(documents), "vocabulary")
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("_best"))
    judged = words.join(near, "word", "left").withColumn("form_n", -F.col("_best.less"))
    kept = F.col("form_n") >= ratio * F.col("n")
    judged = materialise(judged.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(kept, F.col("_best.form")).alias("form"), F.when(kept, F.col("form_n")).alias("form_n")), "judged")
    last = roots(judged.where("form is not null"))
    return judged.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
