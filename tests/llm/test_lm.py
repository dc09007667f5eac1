import math
from collections import Counter

import pytest

from textloom.llm import lm


def brute(rows, order, least, alpha):
    docs = [(i, (t or "").lower().split()) for i, t, _ in rows]
    counts = Counter(tuple(w[k : k + n]) for _, w in docs for n in range(1, order + 1) for k in range(len(w) - n + 1))
    total = sum(len(w) for _, w in docs)
    out = []
    for i, w in docs:
        s = 0.0
        for k in range(len(w)):
            factor = 1.0
            for n in range(min(order, k + 1), 0, -1):
                g = tuple(w[k - n + 1 : k + 1])
                if n == 1 or counts[g] >= least:
                    s += math.log(factor * (counts[g] / counts[g[:-1]] if n > 1 else counts[g] / total))
                    break
                factor *= alpha
        out.append((i is None, i or 0, len(w), round(s, 6)))
    return sorted(out)


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_equals_brute_force(documents, order):
    rows = [(k, " ".join(f"w{(k * j * j + j) % 11}" for j in range(k % 17)), "s") for k in range(60)]
    rows += [(100, None, "s"), (101, "", "s"), (102, "only", None), (None, "w1 w2 w3", "s"), (3, rows[3][1], "s"), (103, "a b " * 5000, "s")]
    out = lm.score_documents(documents(rows), order=order, chunk_tokens=50)
    assert lm.MIN_COUNT == 1
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, round(r.log_score, 6)) for r in out.collect()) == brute(rows, order, 1, lm.ALPHA)


def test_empty(documents):
    assert lm.score_documents(documents([])).count() == 0


def test_keys_pack():
    import numpy as np

    for keys in (np.zeros(0, np.uint64), np.array([5], np.uint64), np.array([0, 2**63], np.uint64), np.unique(np.random.default_rng(0).integers(0, 2**63, 5000).astype(np.uint64) * np.uint64(2))):
        assert (lm.unpack_sorted(lm.pack_sorted(keys)) == keys).all()
        assert (lm.unsqueezed(lm.squeezed(keys % np.uint64(2**32))) == keys % np.uint64(2**32)).all()


@pytest.mark.parametrize("order, least", [(3, 2), (4, 2), (3, 3)])
def test_backoff_below_min_count(documents, order, least):
    rows = [(k, " ".join(f"w{(k * j * j + j) % 11}" for j in range(k % 17)), "s") for k in range(60)] + [(100, "rare words stand here once", "s")]
    out = lm.score_documents(documents(rows), order=order, min_count=least, chunk_tokens=50)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, round(r.log_score, 6)) for r in out.collect()) == brute(rows, order, least, lm.ALPHA)


def test_query_equals_its_sql(spark, small):
    duckdb = pytest.importorskip("duckdb")
    from textloom.llm import queries

    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
        wanted = db.execute(queries.oracle_sql()["op3_lm_score"]).fetchall()
    got = [tuple(r) for r in queries.op3_lm_score(spark, small).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert [(r[0], r[1]) for r in sorted(got, key=key)] == [(r[0], r[1]) for r in sorted(wanted, key=key)]
    assert all(abs(a[2] - b[2]) < 1e-3 for a, b in zip(sorted(got, key=key), sorted(wanted, key=key)))


def test_counts_beyond_32_bits(spark):
    import numpy as np

    large = np.array([1, 2**32 - 1, 2**32, 2**45 + 3], np.uint64)
    assert (lm.unsqueezed(lm.squeezed(large)) == large).all()
    keys = np.array([3, 7], np.uint64)
    rows = [(c, 0, "p", bytearray(lm.pack_all([lm.pack_sorted(keys), lm.squeezed(np.array([2**32 - 1, 1]))]))) for c in range(3)]
    replies = lm._sum_counts(spark.createDataFrame(rows, lm.SCHEMA), 1).collect()
    assert [lm.unsqueezed(lm.unpack_all(bytes(r.payload))[0]).tolist() for r in replies] == [[3 * (2**32 - 1), 3]] * 3


def test_control_characters_are_white_space_everywhere(documents):
    """The total and the tokens follow one rule of white space."""
    apart, plain = (lm.score_documents(documents([(1, t, "s"), (2, "c", "s")])).collect() for t in ("a\x1cb", "a b"))
    assert sorted((r.n_tokens, r.log_score) for r in apart) == sorted((r.n_tokens, r.log_score) for r in plain)


def test_more_partitions_with_more_tokens(documents, monkeypatch):
    monkeypatch.setattr(lm, "PART_TOKENS", 20)
    rows = [(k, " ".join(f"w{(k * j + j) % 13}" for j in range(k)), "s") for k in range(40)]
    out = lm.score_documents(documents(rows), chunk_tokens=60)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, round(r.log_score, 6)) for r in out.collect()) == brute(rows, 3, 1, lm.ALPHA)
