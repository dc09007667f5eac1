import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from textloom.operators import language


def grams(word):
    x = f" {word} "
    return [g for n in (1, 2, 3) for g in (x[k : k + n] for k in range(len(x) - n + 1)) if g != " "]


def by_hand(labelled, texts):
    counts = {}
    for lang, text in labelled:
        for word in (text or "").lower().split() if lang else []:
            for g in grams(word):
                counts.setdefault(g, Counter())[lang] += 1
    known = {g: c for g, c in counts.items() if sum(c.values()) >= 2}
    langs = sorted({x for c in counts.values() for x in c})
    of = lambda n: [c for g, c in known.items() if len(g) == n]
    p = {g: [math.log((c[x] + 0.5) / (sum(d[x] for d in of(len(g))) + 0.5 * len(of(len(g))))) for x in langs] for g, c in known.items()}
    out = {}
    for key, text in texts:
        total, n = [0.0] * len(langs), 0
        for word in (text or "").lower().split():
            own = [p[g] for g in grams(word) if g in p]
            if own:
                total = [t + sum(x) / len(own) for t, x in zip(total, zip(*own))]
                n += len(own)
        if n:
            weights = [math.exp(t - max(total)) for t in total]
            out[key] = (n, {x: w / sum(weights) for x, w in zip(langs, weights)})
    return out


LABELLED = [("en", "the cat sat on the mat and the dog ran"), ("de", "die katze lag auf der matte und der hund lief"), ("fr", "le chat est sur le tapis et le chien court"), (None, "not heard of"), ("en", None), ("de", "")]


@pytest.mark.parametrize("few", [500_000, 0])
def test_scores_by_hand(table, monkeypatch, few):
    monkeypatch.setattr(language, "BROADCAST_ROWS", few)
    texts = [(1, "the dog"), (2, "der hund und die katze"), (3, "Le chien LE chien"), (4, ""), (5, None), (6, "ω"), (7, "the " * 3000)]
    known, languages = language.learn(table("lang string, text string", LABELLED))
    assert languages == ["de", "en", "fr"]
    df = table("k int, t string", texts).select("k", language.words_of(F.col("t")).alias("w"))
    got = {r.k: (r.grams, {s["lang"]: s["score"] for s in r.scores}) for r in language.text_scores(df, ["k"], "w", known, languages).collect()}
    want = by_hand(LABELLED, texts)
    assert set(got) == set(want)
    for k, (n, scores) in want.items():
        assert got[k][0] == n and all(abs(got[k][1][x] - scores[x]) < 1e-9 for x in scores)
    best = language.text_scores(df, ["k"], "w", known, languages).select("k", language.likeliest(F.col("scores"))["lang"].alias("lang"))
    assert {r.k: r.lang for r in best.collect() if r.k < 4} == {1: "en", 2: "de", 3: "fr"}


def test_nothing_to_learn_from(table):
    known, languages = language.learn(table("lang string, text string", []))
    assert languages == [] and known.collect() == []


def test_held_out_documents_are_told_apart(spark):
    """The query's own split of a whole table."""
    from textloom.plans import catalogue

    out = catalogue.queries()["ngram_languages"](spark, "/root/testdata/sf0.01").where("held_out and language is not null").collect()
    assert len(out) > 100 and sum(bool(r.correct) for r in out) / len(out) >= 0.97
