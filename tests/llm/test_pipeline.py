import numpy as np
import pytest
import test_jaccard
import test_line_dedup

import corpus_pipeline
from textloom.llm import packing


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Toxic documents, near copies, and a line on many sites, among plain ones."""
    where = str(tmp_path_factory.mktemp("sf"))
    rng = np.random.default_rng(8)
    words = [f"w{k}" for k in range(400)]
    rows, labels = [], []
    for k in range(420):
        text = list(rng.choice(words, rng.integers(20, 60)))
        if k % 5 == 0:
            for _ in range(4):
                text.insert(int(rng.integers(len(text))), str(rng.choice(["vile", "nasty"])))
        body = " ".join(text)
        if k % 7 == 3:
            body = rows[-1][1].split("\n")[0] + " more"
        rows.append((k, body + ("\nsubscribe now" if k % 3 == 0 else ""), f"s{k % 11}"))
        labels.append((k, 1, int("vile" in body or "nasty" in body)))
    rows += [(500, None, "s1"), (501, "", "s1"), (None, "no id", "s2")]
    full = [(i, t, "en", s, None if t is None else len(t), "extra") for i, t, s in rows]
    spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string, n_chars bigint, n_removed string").write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return where, rows


def test_stages_equal_brute_force(spark, folder, tokenizer_path):
    where, rows = folder
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_jaccard_join", "best_fit_packing"]
    docs = spark.read.parquet(f"{where}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        path = f"{where}/{name}"
        stage(spark, docs, where).write.parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = docs
        assert name == "best_fit_packing" or docs.columns == columns
    texts = lambda df: sorted(((r.doc_id is None, r.doc_id or 0, r.text) for r in df.collect()), key=str)
    clean = [r for r in rows if not {"vile", "nasty"} & set((r[1] or "").split())]
    assert texts(seen["toxicity"]) == sorted(((i is None, i or 0, t) for i, t, _ in clean), key=str)
    lines = [x[:3] for x in test_line_dedup.brute(clean, 8)]
    assert texts(seen["line_dedup"]) == sorted(lines, key=str) and any("subscribe" in (t or "") for *_, t in lines)
    assert {r.n_removed for r in seen["line_dedup"].collect()} == {"extra"}
    assert all(r.n_chars is None or r.n_chars == len(r.text) for r in seen["line_dedup"].collect())
    after = [(None if missing else i, t, None) for missing, i, t in lines]
    keep = {i for missing, i, c, _ in test_jaccard.brute(after) if not missing and c == i}
    assert texts(seen["ngram_jaccard_join"]) == sorted([x for x in lines if x[0] or x[1] in keep], key=str)
    want = packing.token_pieces(seen["ngram_jaccard_join"], tokenizer_path).drop("in_bucket", "bucket")
    assert seen["best_fit_packing"].select(*want.columns).exceptAll(want).count() == 0 and want.count() == seen["best_fit_packing"].count()


def test_run_on_the_smallest_tables(spark, small):
    out = corpus_pipeline.run(spark, small).toPandas().sort_values(["sequence_id", "offset"])
    assert len(out) and (out.groupby("sequence_id")["length"].cumsum() - out["length"] == out["offset"]).all()


def test_run_on_empty_tables(spark, folder, tmp_path):
    where, _ = folder
    for name in ("documents", "labels"):
        spark.read.parquet(f"{where}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_unrelated_rows_of_an_id_stay(spark, folder, documents):
    """A near copy goes by its row: other texts under its doc_id, or under that of the document that stays, don't."""
    words = " ".join(f"k{n}" for n in range(50))
    rows = [(2, "an unrelated text under the same id", "s"), (2, words + " more", "s"), (1, words, "s"), (3, words + " again", "s"), (3, "one more that nobody else has", "s")]
    for order in (rows, rows[::-1]):
        kept = corpus_pipeline.drop_near_duplicates(spark, documents(order), "").collect()
        assert sorted((r.doc_id, r.text) for r in kept) == sorted([rows[0][:2], rows[2][:2], rows[4][:2]])
