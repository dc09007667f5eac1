import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.functions.vectors import cosine_distance
from textloom.operators import drift, embedding, report, resample, senses, similarity
from textloom.operators.duplicates import checkpoint


def test_cooccurrence_leaves_rare_words_out_first(table):
    lines = table("cell string, line int, w array<string>", [("c", 1, ["a", "rare", "b", "a"]), ("c", 2, ["b"])])
    vocabulary = embedding.cell_vocabulary(lines, "cell", "w", 2)
    counts = {(r.a, r.b): r.n for r in embedding.cooccurrence(lines, "cell", "line", "w", vocabulary, 1).collect()}
    assert counts == {("a", "b"): 2, ("b", "a"): 2}


def test_ppmi_formula(table):
    counts = table("cell string, a string, b string, n long", [("c", "x", "y", 6), ("c", "y", "x", 6), ("c", "x", "z", 1), ("c", "z", "x", 1), ("c", "z", "z", 4)])
    got = {(r.a, r.b): r.value for r in embedding.ppmi(counts, "cell").collect()}
    n = {"x": 7, "y": 6, "z": 5}
    s = sum(v**0.75 for v in n.values())
    want = {(a, b): math.log(k / n[a] / (n[b] ** 0.75 / s)) for a, b, k in (("x", "y", 6), ("y", "x", 6), ("x", "z", 1), ("z", "x", 1), ("z", "z", 4))}
    assert {k: round(v, 9) for k, v in got.items()} == {k: round(v, 9) for k, v in want.items() if v > 0}


def test_svd_gram(table):
    rng = np.random.default_rng(0)
    m = np.abs(rng.normal(size=(12, 12)))
    m = m + m.T
    rows = [("c", f"w{i:02}", f"w{j:02}", float(m[i, j])) for i in range(12) for j in range(12)]
    out = embedding.svd_vectors(table("cell string, a string, b string, value double", rows), "cell", 12, 0.5).orderBy("word").collect()
    u, s, _ = np.linalg.svd(m)
    v = np.array([r.vec for r in out])
    assert np.allclose(v @ v.T, (u * s) @ u.T, atol=1e-6)


def test_cut_lines(table):
    out = embedding.cut_lines(table("w array<string>", [(list("abcde"),), ([],)]), "w", 2).collect()
    assert [r.w for r in out] == [["a", "b"], ["c", "d"], ["e"], []]


def test_group_distances_equal_pairs(table):
    rng = np.random.default_rng(1)
    rows = [("a" if k < 5 else "b", rng.normal(size=4).tolist()) for k in range(11)]
    r = similarity.group_distances(table("g string, v array<double>", rows), "g", "v").first()
    unit = [np.array(v) / np.linalg.norm(v) for _, v in rows]
    a, b = unit[:5], unit[5:]
    mean = lambda pairs: np.mean([1 - x @ y for x, y in pairs])
    within = lambda g: mean([(x, y) for i, x in enumerate(g) for y in g[:i]])
    across = mean([(x, y) for x in a for y in b])
    assert np.allclose([r.across, r.within_a, r.within_b, r.j], [across, within(a), within(b), across - (within(a) + within(b)) / 2])


def test_top_neighbours_in_blocks(table):
    rng = np.random.default_rng(2)
    rows = [(k, rng.normal(size=3).tolist()) for k in range(50)]
    df = table("k long, v array<double>", rows)
    one, many = ({(r.k, r.other, r["rank"]) for r in similarity.top_neighbours(df, "k", "v", 5, blocks=n).collect()} for n in (1, 4))
    assert one == many and len(one) == 250


def test_top_neighbours_in_blocks_over_many_partitions(spark, table):
    """Both sides of a pair of blocks meet, however many partitions there are."""
    rng = np.random.default_rng(3)
    df = table("k long, v array<double>", [(k, rng.normal(size=3).tolist()) for k in range(60)])
    settings = {"spark.sql.shuffle.partitions": "32", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        one, many = ({(r.k, r.other, r["rank"]) for r in similarity.top_neighbours(df, "k", "v", 5, blocks=n).collect()} for n in (1, 3))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert one == many and len(one) == 300


def test_cosine_edges(table):
    df = table("a array<double>, b array<double>", [([0.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [2.0, 0.0]), ([1.0, 0.0], [-3.0, 0.0])])
    assert [r[0] for r in df.select(cosine_distance(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 2.0]


def test_percentiles_and_bins(table):
    pairs = table("word string, count_a long, count_b long, v double", [(f"w{k:03}", 10 + k, 10 + k, float(k // 2)) for k in range(300)] + [("nan", 5, 5, float("nan"))])
    out = drift.add_noise_floor(pairs, ["v"]).collect()
    assert {r.bin for r in out} == {0, 1, 2}
    assert next(r for r in out if r.word == "nan").v_percentile is None
    tied = [r for r in out if r.v == 0.0]
    assert len({r.v_percentile for r in tied}) == 1
    assert all(r.is_candidate == (r.v_percentile is not None and r.v_percentile > 95) for r in out)


def test_movement(table):
    schema = "word string, flag boolean, v double"
    a = table(schema, [("x", True, 1.0), ("y", True, 2.0), ("z", False, 3.0)])
    b = table(schema, [("x", True, 1.0), ("y", False, 2.0), ("z", True, 3.0), ("new", True, 0.0)])
    r = drift.movement(a, b, "word", "flag", "v").first()
    assert (r.entering, r.leaving, r.flag_turnover, round(r.rank_disagreement, 9)) == (2, 1, 0.75, 0.0)
    none = table(schema, [("x", False, 1.0)])
    r = drift.movement(none, none, "word", "flag", "v").first()
    assert r.flag_turnover == 0.0 and r.rank_disagreement is None


def test_cell_pairs(table):
    cells = table("field string, decade long", [("a", 1990), ("a", 2000), ("a", 2020), ("b", 2000)])
    assert [tuple(r) for r in drift.within_field_pairs(cells, "field", "decade").collect()] == [("a", 1990, 2000)]
    assert [tuple(r) for r in drift.cross_field_pairs(cells, "field", "decade").collect()] == [(2000, "a", "b")]


def test_merge_and_segments(table):
    ranges = resample.merge_ranges(table("k int, start long, end long", [(1, 5, 8), (1, 7, 9), (1, 20, 21), (1, 9, 10)]), "k")
    assert sorted((r.start, r.end) for r in ranges.collect()) == [(5, 10), (20, 21)]
    tokens = table("k int, at long, start long, end long", [(1, i, 3 * i, 3 * i + 2) for i in range(8)] + [(2, 0, 0, 2)])
    out = resample.kept_segments(tokens, "k", ranges)
    assert sorted((r.k, r.segment, r.first, r.tokens) for r in out.collect()) == [(1, 0, 0, 2), (1, 1, 4, 3), (1, 2, 7, 1), (2, 0, 0, 1)]


def test_bootstrap_draws_n(table):
    out = resample.bootstrap(table("k long, cell string", [(k, "a" if k < 30 else "b") for k in range(50)]), "k", "cell", 5)
    assert {(r.cell, r.replicate): r.n for r in out.groupBy("cell", "replicate").agg(F.sum("times").alias("n")).collect()} == {(c, r): n for c, n in (("a", 30), ("b", 20)) for r in range(1, 6)}


def test_permutation_finds_a_difference(table):
    df = table("k long, v double", [(k, float(k >= 50) + k % 3) for k in range(100)])
    assert resample.rank_test(checkpoint(resample.permutation_null(df, "k", F.col("k") < 50, F.col("v"), 19))).first().p == 0.05


@pytest.mark.parametrize("text, sense", [("the river bank was", "river"), ("money in the bank of", "money"), ("river money bank", None), ("a bank", None), ("bank loan", "money"), ("loan bank", None), ("river old bank", "river"), ("river bank not", None)])
def test_cues(table, text, sense):
    cues = {"river": ["<river", "!not"], "money": ["money", ">>loan"]}
    start = text.index("bank")
    left, right = senses.around(F.lit(text), F.lit(start), F.lit(start + 4))
    assert table("x int", [(1,)]).select(senses.cue_sense(cues, left, right)).first()[0] == sense


def test_shares_and_divergence(table):
    d = senses.shares(table("cell string, s string", [("a", "x"), ("a", "x"), ("b", "y"), ("b", None), ("c", "x"), ("c", "y")]), "cell", "s")
    got = {(r.cell_a, r.cell_b): round(r.divergence, 6) for r in senses.divergences(checkpoint(d), "cell", "s").collect()}
    assert got == {("a", "b"): 1.0, ("a", "c"): 0.311278, ("b", "c"): 0.311278}


def test_adjusted_shares(table):
    matrix = table("truth string, predicted string, share double", [("a", "a", 0.9), ("a", "b", 0.1), ("b", "a", 0.2), ("b", "b", 0.8)])
    observed = table("label string, share double", [("a", 0.9 * 0.3 + 0.2 * 0.7), ("b", 0.1 * 0.3 + 0.8 * 0.7)])
    assert {r.label: round(r.share, 6) for r in senses.adjusted_shares(matrix, observed).collect()} == {"a": 0.3, "b": 0.7}


def test_agreement(table):
    r = senses.agreement(table("a string, b string", [("x", "x")] * 4 + [("y", "y")] * 4 + [("x", "y"), ("y", "x"), ("x", None)]), "a", "b").first()
    assert (r["items"], r.exact, round(r.kappa, 6)) == (10, 0.8, 0.6)


def test_report(table):
    schema = "work long, dropped_reason string, flags array<string>, removals array<struct<start:bigint,end:bigint,reason:string>>, field string"
    a = table(schema, [(1, None, ["f"], [(0, 2, "r")], "x"), (2, "short", [], [], "x"), (3, "dup", [], [], "y")])
    b = table(schema, [(1, "dup", ["f"], [(0, 3, "r")], "x"), (2, "short", [], [], "x"), (4, None, [], [], "y")])
    assert tuple(report.totals(a).first()) == (3, 1, 2)
    assert {r.field: (r.short, r.dup, r.total) for r in report.dropped_by(a, "field", ["short", "dup"]).collect()} == {"x": (1, 0, 1), "y": (0, 1, 1)}
    assert {(r.before, r.now): r.works for r in report.transitions(a, b).collect()} == {("kept", "dup"): 1, ("dup", "absent"): 1, ("absent", "kept"): 1}
    assert tuple(report.removal_changes(a, b).first()) == ("r", 1, 1, 1, 1)
    assert {r.metric: r.change for r in report.compare_metrics(report.metrics(a), report.metrics(b)).collect()} == {}
    assert "| 3 | 1 | 2 |" in report.markdown("Totals", report.totals(a))
    assert report.first_difference("same text", "same test").startswith("'same text'")


def test_auc_and_segments(table):
    from textloom.operators import instruments

    df = table("s double, p boolean", [(1.0, False), (2.0, True), (2.0, False), (3.0, True)])
    assert instruments.auc(df, "s", F.col("p")).first().auc == 0.875
    counts = {"the": 50, "cat": 10, "sat": 5, "thec": 1, "a": 3}
    assert instruments.segment("thecatsat", counts, 100, 5) == ["the", "cat", "sat"]
    assert instruments.segment("dog", counts, 100, 5) == ["dog"]
    v = table("t double, p array<double>, b array<double>", [(0.9, [0.1] * 19, [0.8, 1.0]), (0.9, [0.95] + [0.1] * 18, [0.8]), (0.2, [0.1] * 19, [0.8])])
    assert [r[0] for r in v.select(instruments.verdict(F.col("t"), F.col("p"), F.col("b"))).collect()] == [True, False, False]


def test_classifier(table):
    from textloom.operators import instruments

    seeds = table("name string, v array<double>", [("x", [1.0, 0.1]), ("x", [2.0, 0.0]), ("y", [0.0, 1.0])])
    rows = table("v array<double>", [([3.0, 0.2],), ([0.1, 5.0],)])
    assert [r.prediction for r in instruments.classify(seeds, "name", rows, "v").collect()] == ["x", "y"]
    assert {r.prediction for r in instruments.classify(seeds.where("name = 'x'"), "name", rows, "v").collect()} == {"x"}


def test_version_lines_among_many_ranges(table):
    """As by looking at every range for every token: ranges overlap, touch, repeat and cut tokens in two; dropped works go."""
    rng = np.random.default_rng(5)
    tokens, cuts, want = [], [], {}
    for k in range(8):
        starts = np.cumsum(rng.integers(1, 4, 60))
        mine = [(int(a), int(a + rng.integers(1, 9))) for a in rng.integers(0, 130, 3 * k)]
        cuts += [(k, a, b) for a, b in mine + mine[:2]]
        for at, a in enumerate(map(int, starts)):
            tokens.append((k, at, a, a + 1, f"t{at}"))
            if k != 6 and not any(a < e and a + 1 > s for s, e in mine):
                want.setdefault((k, sum(e <= a for _, e in mine + mine[:2])), []).append(f"t{at}")
    df = table("k int, at int, start long, end long, token string", tokens)
    out = resample.version_lines(df, "k", table("k int, start long, end long", cuts), table("k int", [(6,)]))
    assert {(r.k, r.segment): r.line for r in out.collect()} == {g: " ".join(t) for g, t in want.items()}
    assert "ArrayExists" not in out._jdf.queryExecution().toString() and "exists(cuts" not in out._jdf.queryExecution().toString()


def test_inverted_index_moves_no_word(table):
    from textloom.functions import text as T

    df = table("k int, x string", [(1, 'b "a" b é'), (2, ""), (3, None)])
    out = df.select("k", T.inverted_index(T.words(F.col("x"))).alias("i"))
    assert "Exchange" not in out._jdf.queryExecution().toString()
    back = out.select("k", "i", T.from_inverted_index(F.col("i")).alias("x")).collect()
    assert [tuple(r) for r in back] == [(1, '{"b": [0, 2], "\\"a\\"": [1], "é": [3]}', 'b "a" b é'), (2, "{}", ""), (3, None, None)]


def test_top_neighbours_shuffle_rows_once_for_a_block(spark, table):
    """Whole blocks let all rows pass: ties to the smaller key, keys that repeat and equal vectors count as they do for all pairs."""
    pick = np.random.default_rng(4)
    rows = [(k % 290, pick.integers(-2, 3, 3).astype(float).tolist()) for k in range(300)]
    found = similarity.top_neighbours(table("k long, v array<double>", rows), "k", "v", 4, blocks=3)
    v = np.array([x for _, x in rows])
    unit, want = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300), {}
    for i, (key, _) in enumerate(rows):
        want.setdefault(key, []).extend((-round(float(unit[i] @ unit[j]), 12), rows[j][0]) for j in range(len(rows)) if rows[j][0] != key)
    got = {}
    for r in found.collect():
        got.setdefault(r.k, []).append((-r.similarity, r.other))
    assert {k: sorted(x) for k, x in got.items()} == {k: sorted(x)[:4] for k, x in want.items()}


def test_top_neighbours_take_blocks_of_more_than_four_thousand_rows(spark):
    rows = spark.range(9000).selectExpr("id as k", "array(cast(id as double), 1D) as v")
    found = similarity.top_neighbours(rows, "k", "v", 1)
    assert found.count() == 9000
    assert "MapInArrow" in found._jdf.queryExecution().toString() and "FlatMapCoGroups" not in found._jdf.queryExecution().toString()
