import math
import zlib

import numpy as np

from textloom.llm import toxicity


def planted(n=600):
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(300)]
    rows, labels = [], []
    for k in range(n):
        text = list(rng.choice(words, rng.integers(5, 60)))
        toxic = k % 4 == 0
        if toxic:
            for _ in range(3):
                text.insert(int(rng.integers(len(text))), str(rng.choice(["vile", "nasty", "foul"])))
        rows.append((k, " ".join(text), "s"))
        labels.append((k, 1, int(toxic)))
    return rows, labels


def test_held_out_accuracy(spark, documents):
    rows, labels = planted()
    known = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    out = toxicity.classify_toxicity(documents(rows), known).toPandas()
    assert (out["held_out"] == out["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 3 == 1)).all()
    held = out[out["held_out"]]
    truth = held["doc_id"] % 4 == 0
    assert ((held["predicted"] == 1) == truth).mean() > 0.95
    assert held["score"][truth].min() > held["score"][~truth].median()


def test_labels_of_held_out_rows_change_nothing(spark, documents):
    rows, labels = planted(300)
    schema = "doc_id bigint, quality int, toxic int"
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, q, t in labels]
    a, b = (sorted(toxicity.classify_toxicity(documents(rows), spark.createDataFrame(x, schema)).collect()) for x in (labels, flipped))
    assert a == b


def test_edges(spark, documents):
    schema = "doc_id bigint, quality int, toxic int"
    rows = [(1, None, "a"), (2, "", "a"), (None, "vile", None), (3, "vile " * 30_000, "b"), (3, "vile", "b")]
    none = toxicity.classify_toxicity(documents(rows), spark.createDataFrame([], schema)).collect()
    assert len(none) == 5 and {r.score for r in none} == {0.5} and {r.predicted for r in none} == {0}
    some = spark.createDataFrame([(2, None, 0), (3, 1, 1), (3, 1, 0), (None, 1, 1), (1, 0, None)], schema)
    assert toxicity.classify_toxicity(documents(rows), some).count() == 5
    assert toxicity.classify_toxicity(documents([]), some).count() == 0


def test_weights_are_few():
    rng = np.random.default_rng(0)
    rows = [(np.unique(np.r_[rng.integers(0, 1 << 22, 200), [7] if k % 2 else [8]]).astype(np.uint32), k % 2) for k in range(400)]
    at, w, _ = toxicity.learn(rows)
    assert {7, 8} & set(at.tolist()) and len(at) < 100


def test_learner_equals_plain_ftrl():
    """Weights, coordinate by coordinate, of the published algorithm in plain Python."""
    rng = np.random.default_rng(11)
    rows = [(np.unique(np.r_[rng.integers(0, 40, 6), [41] if k % 3 == 0 else [42]]).astype(np.uint32), int(k % 3 == 0)) for k in range(60)]
    alpha, beta, l1, l2, epochs = 0.5, 1.0, 0.8, 0.1, 3
    z, n, bias, bias_n = {}, {}, 0.0, 0.0
    heavier = min(20.0, max(1.0, sum(1 - y for _, y in rows) / sum(y for _, y in rows)))

    def weight(i):
        if abs(z.get(i, 0.0)) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(epochs):
        for indices, y in rows:
            w = {int(i): weight(int(i)) for i in indices}
            p = 1 / (1 + math.exp(-(sum(w.values()) + bias)))
            g = (p - y) * (heavier if y else 1.0)
            for i, wi in w.items():
                before = n.get(i, 0.0)
                n[i] = before + g * g
                z[i] = z.get(i, 0.0) + g - (math.sqrt(n[i]) - math.sqrt(before)) / alpha * wi
            bias_n += g * g
            bias -= alpha * g / (beta + math.sqrt(bias_n))
    at, w, b = toxicity.learn(rows, epochs, alpha, beta, l1, l2)
    expected = {i: weight(i) for i in z if weight(i)}
    assert set(at.tolist()) == set(expected) and len(expected) < len(z)
    assert np.allclose(w, [expected[i] for i in at.tolist()], rtol=1e-5) and math.isclose(b, bias, rel_tol=1e-9)


def test_scores_equal_plain_sums(spark, documents):
    """A score is the logistic of the bias and the weights of a text's distinct features, for texts of any length."""
    model = (np.array([3, 9], np.uint32), np.array([0.0, 0.0], np.float32), 0.25)
    memo = toxicity.WordHashes()
    texts = ["one two three", "two two two", "word " * 20_000, "", None]
    at = np.unique(np.concatenate([toxicity.feature_indices(t, memo) for t in texts]))
    w = np.linspace(-1, 1, len(at)).astype(np.float32)
    out = {r.doc_id: r for r in toxicity.score(documents([(k, t, "s") for k, t in enumerate(texts)]), (at.astype(np.uint32), w, model[2])).collect()}
    known = dict(zip(at.tolist(), w.tolist()))
    for k, t in enumerate(texts):
        words = (t or "").lower().split()
        features = {int(i) for i in toxicity.feature_indices(t, memo)}
        assert len(features) <= 3 * len(words)
        p = 1 / (1 + math.exp(-(model[2] + sum(known[i] for i in features))))
        assert math.isclose(out[k].score, p, rel_tol=1e-6) and out[k].predicted == int(p >= 0.7)
