import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from textloom.llm import spelling
from textloom.llm.spelling import Automaton, exact_part


def one_apart(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def brute_force(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    n = {w: k for w, k in counts.items() if len(w) >= 6 and k >= 5}
    near = {w: [v for v in n if one_apart(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect()), key=repr)


def words_like(seed, n, alphabet="abé", most=8):
    pick = random.Random(seed)
    return sorted({"".join(pick.choice(alphabet) for _ in range(pick.randint(1, most))) for _ in range(n)})


@pytest.mark.parametrize("seed", range(4))
def test_automaton_is_minimal_and_numbers_its_words(seed):
    words = words_like(seed, 150)
    automaton = Automaton(words)
    assert [automaton.number(w) for w in words] == list(range(len(words)))
    assert automaton.number("zz") is None and automaton.number("") is None
    prefixes = {w[:k] for w in words for k in range(len(w) + 1)}
    assert automaton.n_states == len({frozenset(w[len(p) :] for w in words if w.startswith(p)) for p in prefixes})


@pytest.mark.parametrize("seed", range(4))
def test_half_exact_then_one_error(seed):
    words = words_like(seed, 200)
    automaton = Automaton(words)
    for w in words:
        for size in range(len(w) + 1):
            found = {words[k] for k in automaton.one_error(w[:size], w[size:])}
            assert found == {v for v in words if one_apart(w, v) and any(v == e for e in edits(w, size))}


def edits(w, size):
    for i in range(size, len(w) + 1):
        for c in "abé":
            yield w[:i] + c + w[i:]
            if i < len(w):
                yield w[:i] + c + w[i + 1 :]
        if i < len(w):
            yield w[:i] + w[i + 1 :]


@pytest.mark.parametrize("most", [4, 50_000])
def test_both_directions_find_all_near_words(spark, monkeypatch, most):
    monkeypatch.setattr(spelling, "MOST_SHARE", most)  # 4: shares are cut into parts
    words = [w for w in words_like(1, 900, "abcé", 9) if len(w) >= 6] + ["aaaaaa", "aaaaaaa", "aaaaaab"]
    words = sorted(set(words))
    table = spark.createDataFrame([(w, len(w) + k) for k, w in enumerate(words)], "word string, n long")
    found = {(r["word"], r["near"], r["near_n"]) for r in spelling.near_words(table).collect()}
    n = {w: len(w) + k for k, w in enumerate(words)}
    assert found == {(w, v, n[v]) for w in words for v in words if one_apart(w, v)}


def test_halves():
    assert [(exact_part(n, False), exact_part(n, True)) for n in (6, 7)] == [(3, 3), (3, 4)]


def test_nulls_ties_chains_and_extra_columns(documents):
    text = "colour " * 40 + "color_x colours " * 8 + "Colours É" + " centré" * 30 + " centre" * 30 + " centra" * 6 + " aaaaaaa" * 700 + " aaaaaab" * 100 + " aaaaabb" * 10 + " short no" * 9
    rows = [(1, text, "s"), (2, None, "s"), (3, "", None), (None, text, "s"), (1, text, "s"), (4, "x" * 200_000, "s"), (5, "ÀÉÎõü÷× ÀÉÎõü÷×" * 9, "s")]
    table = documents(rows).withColumns({"word": F.lit("mine"), "n": F.lit(1), "half": F.lit(2), "root": F.lit(3)})
    got = rows_of(spelling.spelling_variants(table))
    assert got == brute_force([(i, t) for i, t, _ in rows])
    assert [r[2] for r in got if r[0] == "aaaaabb"] == ["aaaaaaa"]  # by way of aaaaaab


def test_empty_table(documents):
    assert spelling.spelling_variants(documents([])).collect() == []


def test_a_whole_table(spark, small):
    table = spark.read.parquet(f"{small}/documents.parquet")
    assert rows_of(spelling.spelling_variants(table)) == brute_force([(r["doc_id"], r["text"]) for r in table.collect()])
