import re

import pytest
from pyspark.sql import functions as F

from textloom import checks
from textloom.functions import text as T
from textloom.operators import cleaning, duplicates, report

REMOVALS = "array<struct<start:bigint,end:bigint,reason:string>>"
WORKS = f"work string, text string, removals {REMOVALS}, flags array<string>, dropped_reason string"


@pytest.fixture
def works(table):
    return lambda rows: table(WORKS, [(w, t, r, [], d) for w, t, r, d in rows])


def test_sentence_spans_match_the_text(table):
    text = "First one. Second!  Third?\nLast"
    row = table("t string", [(text,)]).select(T.sentence_spans(F.col("t")).alias("s")).first()
    assert [(text[s.start : s.end], s.sentence) for s in row.s] == [(x, x) for x in ("First one.", "Second!", "Third?", "Last")]


def test_spans_count_code_points(table):
    text = "😀 a. b"
    s = table("t string", [(text,)]).select(T.sentence_spans(F.col("t")).alias("s")).first().s
    assert [text[x.start : x.end] for x in s] == ["😀 a.", "b"]


@pytest.mark.parametrize("ranges, expected", [([], "abcdefgh"), ([(0, 2)], "cdefgh"), ([(2, 4)], "ab efgh"), ([(2, 5), (4, 6)], "ab gh"), ([(6, 8)], "abcdef"), ([(0, 8)], ""), ([(4, 6), (0, 1)], "bcd gh")])
def test_kept_text(works, ranges, expected):
    df = works([("w", "abcdefgh", [(a, b, "r") for a, b in ranges], None)])
    assert df.select(T.kept_text(F.col("text"), F.col("removals"))).first()[0] == expected


def test_templates_count_kept_works_and_mask_digits(works):
    shared = lambda k: f"Copyright {k} by us."
    rows = [(f"w{k}", f"{shared(k)} A sentence of its own number {'x' * (k + 3)}.", [], None) for k in range(3)]
    rows += [("short", shared(9), [], None), ("gone", shared(10), [], "early")]
    out = {r.work: r for r in cleaning.mark_templates(works(rows), "work", 4).collect()}
    assert out["short"].dropped_reason == "template" and out["gone"].dropped_reason == "early" and out["gone"].removals == []
    assert all(out[f"w{k}"].removals[0].reason == "template_sentence" and out[f"w{k}"].dropped_reason is None for k in range(3))
    none = cleaning.mark_templates(works(rows), "work", 5)
    assert none.where("dropped_reason = 'template'").count() == 0


def test_repeated_sentences_stay_once(works):
    df = works([("w", "Same here. Other. Same here.", [], None)])
    rows = cleaning.repeated_sentences(cleaning.sentence_rows(df, "work"), "work").collect()
    assert [(r.start, r.end) for r in rows] == [(18, 28)]
    marked = cleaning.add_removals(df, cleaning.repeated_sentences(cleaning.sentence_rows(df, "work"), "work"), "work", "repeated")
    again = cleaning.add_removals(marked, marked.select("work", F.explode("removals").alias("r")).select("work", "r.*"), "work", "other")
    assert [tuple(r) for r in again.first().removals] == [(18, 28, "repeated")]


def test_first_reason_wins(works):
    df = works([("a", "x", [], None), ("b", "x", [], "old")])
    out = {r.work: r.dropped_reason for r in cleaning.mark_dropped(df, df.select("work"), "work", "new").collect()}
    assert out == {"a": "new", "b": "old"}


@pytest.mark.parametrize("text, removals, flagged", [("Ends.", [], False), ("Cut off", [], True), ('He said "yes."', [], False), ("See (1)", [], True), ("Cut http://x", [(4, 12, "url")], False), ("", [], False), ("Why?  ", [], False)])
def test_truncated(works, text, removals, flagged):
    assert (cleaning.mark_truncated(works([("w", text, removals, None)]), "work").first().flags == ["truncated"]) is flagged


def test_author_cap_lowers_coauthors(table):
    """Three works of a and b, two more of b: capping a to two frees one of b's."""
    rows = [(f"w{k}", ["a", "b"] if k < 3 else ["b"], "c") for k in range(5)] + [("x", ["z"], "c")]
    gone = {r.work for r in cleaning.cap_authors(table("work string, authors array<string>, cell string", rows), "work", "authors", ["cell"], 0.0, 2).collect()}
    left = [r for r in rows if r[0] not in gone]
    for author in "ab":
        assert sum(author in names for _, names, _ in left) <= 2
    assert len(gone) == 3


def test_merge_cells(table):
    rows = [("w", "b", 2, "late"), ("w", "a", 1, "first"), ("w", "a", 3, "later"), ("v", "c", 1, "only")]
    out = {r.work: r for r in cleaning.merge_cells(table("work string, field string, line int, title string", rows), "work", "field", ["line"], ["title"]).collect()}
    assert out["w"].title == "first" and out["w"].fields == ["a", "b"] and out["v"].fields == ["c"]


def hundred(changes=()):
    return " ".join(dict(changes).get(k, f"word{k}") for k in range(100))


def test_near_duplicates_and_chain(table):
    """a ~ b ~ c without a ~ c: only b goes; an unrelated text stays out."""
    rows = [("a", hundred()), ("b", hundred([(k, "x") for k in (0, 1, 2, 3, 4, 5)])), ("c", hundred([(k, "x") for k in (0, 1, 2, 3, 4, 5)] + [(k, "y") for k in range(94, 100)])), ("d", "other words")]
    s = duplicates.shingle_sets(table("work string, text string", rows), "work")
    pairs = duplicates.similar_pairs(s, "work", 0.8)
    assert {(r.a, r.b) for r in pairs.collect()} == {("a", "b"), ("b", "c")}
    numbered = pairs.select(F.ascii("a").cast("long").alias("a"), F.ascii("b").cast("long").alias("b"), "similarity")
    assert {(r.work, r.duplicate_of) for r in duplicates.resolve_greedily(numbered).collect()} == {(98, 97)}


def resolved(rows, threshold=0.8):
    """One work after the other against the kept ones before it."""
    sets = {k: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for k, w in ((k, t.lower().split()) for k, t in rows) if w}
    kept, out = [], set()
    for k in sorted(sets):
        near = [(-len(sets[k] & sets[j]) / len(sets[k] | sets[j]), j) for j in kept]
        near = [x for x in near if -x[0] >= threshold]
        if near:
            out.add((k, min(near)[1]))
        else:
            kept.append(k)
    return out


def test_near_duplicates_equal_brute_force(table):
    """Copies, chains and revisions: representatives' pairs and the classes give what comparing every two works gives."""
    import random

    rng = random.Random(3)
    rows, n = [], 0
    for _ in range(8):
        base = [f"v{rng.randrange(60)}" for _ in range(rng.randrange(8, 90))]
        for _ in range(rng.randrange(1, 9)):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                w[rng.randrange(len(w))] = f"u{rng.randrange(9)}"
            rows.append((n, " ".join(w)))
            n += 1
    rows = [(k, t) for k, (_, t) in enumerate(sorted(rows, key=lambda r: rng.random()))] + [(900, ""), (901, "one two"), (902, "One two")]
    pairs, classes = duplicates.near_duplicates(table("work long, text string", rows), "work", 0.8)
    assert {(r.work, r.duplicate_of) for r in duplicates.resolve_near_duplicates(pairs, classes, "work").collect()} == resolved(rows)
    assert all(r.a != r.b for r in pairs.collect()) and {r["class"] for r in classes.where("work in (901, 902)").collect()} == {901}


def test_resolution_says_when_it_is_not_done(table):
    chain = table("a long, b long, similarity double", [(k, k + 1, 0.9) for k in range(12)])
    assert {r.work for r in duplicates.resolve_greedily(chain).collect()} == set(range(1, 13, 2))
    with pytest.raises(RuntimeError):
        duplicates.resolve_greedily(chain, most_rounds=2)


def test_first_length_is_the_first_kept_works(table):
    rows = [(1, "s", "dropped text", "short"), (2, "s", "kept", None), (3, "s", "kept too", None), (4, "t", "gone", "short")]
    out = {r.s: (r.works, r.kept, r.first_length, r.first_kept) for r in report.outcomes_with_example(table("work long, s string, text string, dropped_reason string", rows), "s", "text").collect()}
    assert out == {"s": (3, 2, 4, 2), "t": (1, 0, None, None)}


def test_shingles_of_short_texts(table):
    rows = [(1, None), (2, ""), (3, "one two"), (4, "One  two"), (5, "a b c d e f")]
    out = duplicates.shingles(table("k int, text string", rows), "k").collect()
    assert sorted((r.k, r.n) for r in out) == [(3, 1), (4, 1), (5, 2), (5, 2)]
    assert len({r.shingle for r in out if r.k in (3, 4)}) == 1


def test_checks(table):
    df = table("work_id string, n int", [("a", 1), ("a", None), ("b", 5)])
    assert checks.violations(df, {"small": "n < 3"}, "work_id") == {"small": 2, "unique work_id": 1}
    with pytest.raises(ValueError, match="small"):
        checks.check(df, {"small": "n < 3"})
    with pytest.raises(ValueError, match="1 rows"):
        checks.check_reference(df, table("work_id string", [("a",)]), ["work_id"])


@pytest.mark.parametrize("most", [200_000, 3])
@pytest.mark.parametrize("seed", [1, 2])
def test_author_caps_of_cells_of_any_size(table, monkeypatch, seed, most):
    """In one task for each cell, and in rounds, as one author after the other."""
    import hashlib
    import random

    monkeypatch.setattr(cleaning, "MOST_GROUP", most)
    pick = random.Random(seed)
    rows = [(k, pick.choice("xy"), pick.sample("abcdefghij", pick.randint(0, 3)) + pick.choices("ab", k=pick.randint(0, 1))) for k in range(120)] + [(500, "z", ["a"]), (501, None, ["a"])]
    want = set()
    for cell in "xyz":
        works = sorted((hashlib.sha256(str(k).encode()).hexdigest(), k, set(a)) for k, c, a in rows if c == cell)
        limit, gone = max(3, int(0.1 * len(works))), set()
        counts = {a: sum(a in names for _, _, names in works) for _, _, names in works for a in names}
        for a in sorted(counts, key=lambda a: (-counts[a], a)):
            if counts[a] > limit:
                gone |= {k for k in [k for _, k, names in works if a in names and k not in gone][limit:]}
        want |= gone
    got = {r.k for r in cleaning.cap_authors(table("k int, c string, a array<string>", rows), "k", "a", ["c"], 0.1, 3).collect()}
    assert got == want and len(want) > 10


def test_long_texts_are_cut_as_short_ones(table):
    """Sentences, kept texts and ranges of texts of many runs and chunks, with characters of one to four bytes."""
    import random

    rng = random.Random(4)
    texts = ["", "A.", "ab"] + ["".join(rng.choice(["é", "x", "𝄞 ", "One two. ", "Dreißig!\n", "a? "]) for _ in range(n)) for n in (10, 63, 64, 65, 700, 3000)]
    ranges = [sorted((a, min(len(x), a + rng.randint(0, 40))) for a in (rng.randint(0, len(x)) for _ in range(len(x) // 9))) for x in texts]
    df = table("k int, x string, r array<struct<start:bigint,end:bigint>>", [(k, x, r) for k, (x, r) in enumerate(zip(texts, ranges))] + [(99, None, [])])
    got = {r.k: r for r in df.select("k", "x", T.sentence_spans(F.col("x")).alias("s"), T.kept_text(F.col("x"), F.col("r")).alias("kept"), F.transform("r", lambda r: T.cut(T.chunks(F.col("x")), r["start"], r["end"] - r["start"])).alias("cuts")).collect()}
    assert got[99].s is None and got[99].kept is None
    for k, (x, r) in enumerate(zip(texts, ranges)):
        assert [s.sentence for s in got[k].s] == [x[s.start : s.end] for s in got[k].s]
        assert [s.sentence for s in got[k].s] == [p for p in re.sub(r"([.!?])[ \n]+", "\\1\x01", x).split("\x01") if p]
        at, pieces = 0, []
        for a, b in r:
            pieces += [x[at:a]] if a > at else []
            at = max(at, b)
        assert got[k].kept == " ".join(pieces + ([x[at:]] if at < len(x) else []))
        assert got[k].cuts == [x[a:b] for a, b in r]
