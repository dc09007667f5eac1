import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import meet, minhash
from textloom.llm.minhash import BINS, ByteHashes, OnePermutation, minhash_dedup


def shingles(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", lower)
    return {tuple(words[k : k + 4]) for k in range(max(1, len(words) - 3))} if words else set()


def brute_force(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and None not in (rows[a][0], rows[b][0]) and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    out = [(i, len(s), None if i is None else least[find(k)]) for k, ((i, _), s) in enumerate(zip(rows, sets))]
    return sorted(((i, n, c, True if i is None else i == c) for i, n, c in out), key=repr)


def rows_of(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_shingles", "component_id", "kept")) for r in df.collect()), key=repr)


def words(pick, n, most=3000):
    return [f"w{pick.randrange(most)}" for _ in range(n)]


def changed(pick, base, n):
    out = list(base)
    for k in pick.sample(range(len(out)), n):
        out[k] = f"x{pick.randrange(10**6)}"
    return out


def test_signatures_estimate_similarity():
    pick = np.random.default_rng(1)
    signer = OnePermutation()
    for size in (5, 60, 400, 5000):
        share = []
        for _ in range(60):
            every = np.unique(pick.integers(0, 2**63, size * 10 // 8, dtype=np.uint64))
            a, b = every[: len(every) * 9 // 10], every[len(every) // 10 :]
            share.append((signer.of(np.sort(a)) == signer.of(np.sort(b))).mean())
        assert abs(np.mean(share) - 0.8) < 0.05


def test_densification_fills_every_bin_from_full_ones():
    signer = OnePermutation()
    one = signer.of(np.array([12345], np.uint64))
    assert len(one) == BINS and len(set(one.tolist())) == 1
    few = signer.of(np.sort(np.random.default_rng(2).integers(0, 2**63, 7, dtype=np.uint64) * np.uint64(2)))
    assert 1 < len(set(few.tolist())) <= 7


def test_words_split_at_the_six_spaces_only():
    memo = ByteHashes()
    of = lambda text: minhash.shingle_set(text, memo).tolist()
    assert of("A b\x0bC\x0cd") == of("a B\tc\r\nD") and len(of("a b c d")) == 1
    assert of("a\x1cb c d e") != of("a b c d e") and of("a b c d e") != of("a b c d e")
    assert of("É a b c") != of("é a b c") and of(None) == of(" \n") == []


def test_nulls_short_texts_repeats_and_extra_columns(documents):
    pick = random.Random(3)
    base = words(pick, 120)
    texts = [(5, " ".join(base)), (3, " ".join(changed(pick, base, 2))), (3, " ".join(changed(pick, base, 3))), (None, " ".join(base)), (9, None), (10, ""), (11, " \t"), (12, "one two"), (4, "ONE two"), (13, "one  two three"),
             (14, "alpha beta gamma delta epsilon"), (15, "alpha beta gamma delta epsilon zeta"), (1, " ".join(words(pick, 60_000))), (5, " ".join(base)), (16, "É b c d"), (17, "é b c d")]
    table = documents([(i, t, "s") for i, t in texts]).withColumns({"component_id": F.lit(1), "size": F.lit(2), "node": F.lit(3), "kept": F.lit("x")})
    assert rows_of(minhash_dedup(table)) == brute_force(texts)


def test_empty_table(documents):
    assert minhash_dedup(documents([])).collect() == []


def test_chains_and_groups_around_a_late_origin(documents):
    """Chains whose ends aren't alike, and copies that are like their origin, but not like each other, the origin having the greatest id."""
    pick = random.Random(4)
    chain, texts = words(pick, 200), []
    for k in range(30):
        texts.append((1000 - k, " ".join(chain)))
        chain = changed(pick, chain, 3)
    base = words(pick, 200)
    texts += [(k, " ".join(changed(pick, base, 5))) for k in range(40)] + [(2000, " ".join(base))]
    texts += [(3000 + k, " ".join(words(pick, 50))) for k in range(40)]
    assert rows_of(minhash_dedup(documents([(i, t, "s") for i, t in texts]))) == brute_force(texts)


@pytest.mark.parametrize("block, many, pairs", [(2048, 256, 64), (8, 4, 2)])
def test_clusters_that_a_bucket_joins_are_compared_across(documents, monkeypatch, block, many, pairs):
    """Clusters near the threshold: their members share buckets, and a few bridges between others than the leaders link some of them."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(meet, "MANY", many)
    monkeypatch.setattr(minhash, "FIRST_PAIRS", pairs)
    pick = random.Random(5)
    base, texts, number = words(pick, 400), [], iter(range(10**6))
    for _ in range(6):
        centre = changed(pick, base, 22)
        for _ in range(12):
            texts.append((next(number), " ".join(changed(pick, centre, pick.randrange(1, 14)))))
    pick.shuffle(texts)
    assert rows_of(minhash_dedup(documents([(i, t, "s") for i, t in texts]))) == brute_force(texts)


def test_a_whole_table(spark, small):
    table = spark.read.parquet(f"{small}/documents.parquet")
    assert rows_of(minhash_dedup(table)) == brute_force([(r["doc_id"], r["text"]) for r in table.collect()])
