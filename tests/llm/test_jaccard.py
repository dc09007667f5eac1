import random

import pytest

from textloom.llm import jaccard
from textloom.llm.components import components


def brute(rows):
    """Class and links of each row by comparing every two texts."""
    sets = []
    for _, t, _ in rows:
        w = (t or "").lower().split()
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    similar = lambda a, b: a == b or bool(a | b) and len(a & b) / len(a | b) >= 0.8
    root = list(range(len(rows)))

    def find(i):
        return i if root[i] == i else find(root[i])

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is not None and rows[j][0] is not None and similar(sets[i], sets[j]):
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted((r[0] is None, r[0] or 0, None if r[0] is None else least[find(i)], links[i]) for i, r in enumerate(rows))


def found(df):
    return sorted((r.doc_id is None, r.doc_id or 0, r.class_id, r.n_links) for r in df.collect())


def corpus(seed=0, groups=12, copies=9):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows, n = [], 0
    for g in range(groups):
        base = [word() for _ in range(rng.randrange(40, 160))]
        for _ in range(rng.randrange(1, copies)):
            w = list(base)
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = word()
            rows.append((n, " ".join(w), "s"))
            n += 1
    return rows


EDGES = [(900, None, "s"), (901, "", "s"), (902, "  \n", None), (903, "one", "s"), (904, "One", "s"), (905, "a b c d", "s"), (906, "a b c d", "s"), (None, "a b c d", "s"), (907, "w " * 20_000, "s")]


def test_equals_brute_force(documents):
    rows = corpus() + EDGES + [(3, corpus()[3][1], "s")]
    assert found(jaccard.jaccard_join(documents(rows))) == brute(rows)


def test_blocks_equal_brute_force(documents, monkeypatch):
    """Components of more than a block's rows are cut into blocks by size and hash."""
    monkeypatch.setattr(jaccard, "BLOCK", 3)
    monkeypatch.setattr(jaccard, "PRUNE_BLOCK", 5)
    rows = corpus(seed=4, groups=3, copies=30)
    assert found(jaccard.jaccard_join(documents(rows))) == brute(rows)


def test_chained_components_fall_apart_before_texts_move(documents, monkeypatch):
    """Buckets chain groups that have nothing in common; signatures alone part them again, and no link is lost."""
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    rows = corpus(seed=6, groups=6, copies=8)
    real, sizes = jaccard._refined, []

    def all_in_one(members, classes):
        root = members.agg({"root": "min"}).first()[0]
        out = real(members.withColumn("root", F.lit(root)), classes)
        sizes.append(max(r["count"] for r in out.groupBy("root").count().collect()))
        return out

    from pyspark.sql import functions as F

    monkeypatch.setattr(jaccard, "_refined", all_in_one)
    assert found(jaccard.jaccard_join(documents(rows))) == brute(rows)
    assert sizes[0] <= 8


@pytest.mark.parametrize("order", [0, 1])
def test_repeated_ids_in_any_order(documents, order):
    """Two texts of one doc_id are two classes, whichever comes first."""
    words = [f"w{k}" for k in range(40)]
    rows = [(1, " ".join(words), "s"), (1, "something else that no other row has", "s")][:: -1 if order else 1] + [(2, " ".join(words + ["more"]), "s")]
    got = found(jaccard.jaccard_join(documents(rows)))
    assert got == brute(rows) == [(False, 1, 1, 0), (False, 1, 1, 1), (False, 2, 1, 1)]


def test_recall_on_a_table(spark, small):
    """Every pair of different texts at the threshold in a whole table is found."""
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text, "s") for r in docs.collect()]
    got, wanted = found(jaccard.jaccard_join(docs)), brute(rows)
    linked = sum(r[3] for r in wanted)
    assert linked and sum(r[3] for r in got) >= 0.9 * linked and all(a[3] <= b[3] for a, b in zip(got, wanted))


def test_several_texts_of_one_doc_id(documents, spark):
    """Each of the texts has its own class and links, and the pipeline drops only the rows that are near-duplicates."""
    import corpus_pipeline

    words = [f"w{k}" for k in range(60)]
    rows = [(1, " ".join(words), "s"), (1, " ".join(words[:55] + ["x"]), "s"), (1, "quite another text stands in this row", "s"), (2, " ".join(words[:57] + ["y"]), "s"), (2, "no other row is like this one here", "s"), (3, " ".join(words[:55] + ["x", "z"]), "s")]
    rows += [(4, " ".join(f"v{k}" for k in range(50)), "s"), (4, "one more row without any copy at all", "s"), (0, " ".join(f"v{k}" for k in range(49)), "s")]
    assert found(jaccard.jaccard_join(documents(rows))) == brute(rows)
    kept = corpus_pipeline.drop_near_duplicates(spark, documents(rows), "")
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == sorted(r[:2] for k, r in enumerate(rows) if k not in (3, 5, 6))


def test_empty(documents):
    assert jaccard.jaccard_join(documents([])).count() == 0


def test_pruning_keeps_pairs_at_the_threshold():
    """At a true similarity of 0.8 a pair is dropped before its exact check less than once in a thousand."""
    import numpy as np

    needed = jaccard.least_matches()
    draws = np.random.default_rng(1).random((20_000, jaccard.VALUES)) < 0.8
    matches = draws.cumsum(axis=1)[:, jaccard.STEP - 1 :: jaccard.STEP]
    assert (matches < np.array(needed)).any(axis=1).mean() < 1e-3
    assert 1 - (1 - 0.8**jaccard.ROWS) ** jaccard.BANDS > 0.999


@pytest.mark.parametrize("edges", [[], [(1, 2)], [(k, k + 1) for k in range(40)], [(0, k) for k in range(1, 30)] + [(50, 51), (51, 49), (60, 60)]])
def test_components(spark, edges):
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in edges:
        if u != v:
            a, b = find(u), find(v)
            root[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in root}


def test_tight_groups_are_counted_and_others_compared(documents, monkeypatch):
    """A large component of copies near its origin, copies farther off, and copies of copies: links and classes as by brute force."""
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    pick = random.Random(11)
    words = lambda n: [f"w{pick.randrange(5000)}" for _ in range(n)]

    def edited(base, n):
        out = list(base)
        for k in pick.sample(range(len(out)), n):
            out[k] = f"x{pick.randrange(10**6)}"
        return out

    base = words(300)
    texts = [" ".join(edited(base, pick.choice([0, 1, 1, 2, 3, 5, 7]))) for _ in range(70)] + [" ".join(base)] * 3
    far = edited(base, 6)
    texts += [" ".join(edited(far, pick.choice([0, 1, 3]))) for _ in range(30)] + [" ".join(words(40)) for _ in range(10)]
    pick.shuffle(texts)
    rows = [(k, t, "s") for k, t in enumerate(texts)]
    sets = [frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) for w in (t.lower().split() for t in texts)]
    near = [[j for j in range(len(sets)) if j != i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])] for i in range(len(sets))]
    seen, least = set(), {}
    for i in range(len(sets)):
        todo, group = [i], set()
        while todo:
            x = todo.pop()
            if x not in seen and x not in group:
                group.add(x)
                todo += near[x]
        seen |= group
        least |= {x: min(group) for x in group}
    calls, real = [], jaccard._tight

    def counted(*args):
        out = real(*args)
        calls.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "_tight", counted)
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.jaccard_join(documents(rows)).collect()}
    assert calls[0] > 20
    assert got == {i: (least[i], len(near[i])) for i in range(len(sets))}


def test_a_chain_of_buckets_makes_work_in_proportion(spark, monkeypatch):
    """Members are compared with those of their own buckets only: a chain of n sets makes at most a constant number of rows for each."""
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    sizes = {}
    real = jaccard._bucket_blocks
    for n in (60, 240):
        pick = random.Random(12)
        words, texts = [f"w{k}" for k in range(100)], []
        for k in range(n):
            words = words[2:] + [f"n{k}a", f"n{k}b"]
            texts.append((k, " ".join(words), "s"))
        made = []
        monkeypatch.setattr(jaccard, "_bucket_blocks", lambda rows, made=made: made.append(real(rows).count()) or real(rows))
        rows = spark.createDataFrame(texts, "doc_id long, text string, source string")
        out = jaccard.jaccard_join(rows).collect()
        assert {r.class_id for r in out} == {0} and all(r.n_links > 0 for r in out)
        sizes[n] = made[0]
    assert 0 < sizes[240] < 6 * sizes[60]


def test_tasks_do_not_make_the_bounds(monkeypatch):
    """The bounds of the pruning are the same for all tasks, which take them as made with the job."""
    from textloom.llm import minhash

    def made(*_):
        raise AssertionError("a task made the bounds")

    monkeypatch.setattr(jaccard, "least_matches", made)
    monkeypatch.setattr(minhash, "least_matches", made, raising=False)
    assert list(jaccard._prune(iter([]))) == [] and list(jaccard._verify(iter([]))) == []
    assert callable(minhash._by_sketch())
