import random

import pytest

from textloom.operators import duplicates

WORKS = "work long, text string"


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def one_after_the_other(rows, threshold=0.8):
    kept, out = [], set()
    for work, text in sorted(rows):
        own = shingles(text)
        near = [(-len(own & s) / len(own | s), k) for k, s in kept if own and len(own & s) >= threshold * len(own | s) - 1e-12]
        if near:
            out.add((work, min(near)[1]))
        elif own:
            kept.append((work, own))
    return out


def edited(pick, words, n):
    out = list(words)
    for k in pick.sample(range(len(out)), n):
        out[k] = f"x{pick.randrange(10**6)}"
    return out


def clusters(seed):
    """Groups around origins, some copies alike among themselves and some not, chains, copies, short texts and strangers."""
    pick = random.Random(seed)
    rows, texts = [], []
    for _ in range(6):
        base = [f"w{pick.randrange(400)}" for _ in range(100)]
        texts += [" ".join(edited(pick, base, pick.randrange(0, 5))) for _ in range(12)]
        for _ in range(6):
            base = edited(pick, base, 2)
            texts.append(" ".join(base))
    texts += [" ".join(f"w{pick.randrange(400)}" for _ in range(pick.randrange(0, 9))) for _ in range(20)] + pick.choices(texts, k=15) + [None, "", "one two", "one two"]
    pick.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("worthwhile", [0.0, 0.2, 1.1])
@pytest.mark.parametrize("seed", [1, 2])
def test_leaders_resolve_as_one_work_after_the_other(table, monkeypatch, seed, worthwhile):
    """With rounds to the end, with the usual switch, and with pairs after one round."""
    monkeypatch.setattr(duplicates, "WORTHWHILE", worthwhile)
    rows = clusters(seed)
    got = {(r.work, r.duplicate_of) for r in duplicates.near_duplicate_resolution(table(WORKS, rows), "work", 0.8).collect()}
    assert got == one_after_the_other(rows)
    again = duplicates.resolve_near_duplicates(*duplicates.near_duplicates(table(WORKS, rows), "work", 0.8), "work")
    assert got == {(r.work, r.duplicate_of) for r in again.collect()}


def test_a_group_of_copies_makes_a_row_for_each(table, monkeypatch):
    """Of 300 near copies of one text, each meets the leader alone."""
    pick = random.Random(3)
    base = [f"w{k}" for k in range(120)]
    rows = [(k, " ".join(edited(pick, base, 1))) for k in range(300)]
    met, real = [], duplicates.verified

    def counted(candidates, *rest):
        met.append(candidates.count())
        return real(candidates, *rest)

    monkeypatch.setattr(duplicates, "verified", counted)
    got = {(r.work, r.duplicate_of) for r in duplicates.near_duplicate_resolution(table(WORKS, rows), "work", 0.8).collect()}
    assert got == {(k, 0) for k in range(1, 300)} and met == [299, 299]


def test_empty_tables(table):
    assert duplicates.near_duplicate_resolution(table(WORKS, []), "work", 0.8).collect() == []
    assert duplicates.near_duplicate_resolution(table(WORKS, [(1, None), (2, "")]), "work", 0.8).collect() == []


def test_all_pairs_with_bounds_by_place(table):
    rows = clusters(4)
    pairs, classes = duplicates.near_duplicates(table(WORKS, rows), "work", 0.8)
    sets = {k: shingles(t) for k, t in rows if shingles(t)}
    first = {k: min(j for j in sets if sets[j] == sets[k]) for k in sets}
    assert {r.work: r["class"] for r in classes.collect()} == first
    want = {(a, b) for a in set(first.values()) for b in set(first.values()) if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert {(r.a, r.b) for r in pairs.collect()} == want
