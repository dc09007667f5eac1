import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from textloom.llm import merkle
from textloom.llm.merkle import ARITY, BLOCK, levels_of, walk


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row, text):
    parts = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)]
    return sha("".join(parts))


def levels(nodes):
    """All levels of a tree, leaves first."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][k : k + 3])) for k in range(0, len(out[-1]), 3)])
    return out


def path(tree, at):
    """(before, after) for each level."""
    out = []
    for level in tree[:-1]:
        run = at // 3 * 3
        out.append(("".join(level[run:at]), "".join(level[at + 1 : run + 3])))
        at //= 3
    return out


def brute_force(rows):
    groups = defaultdict(list)
    for r in rows:
        groups["" if r["source"] is None else "+" + r["source"]].append(r)
    trees = {}
    for name in sorted(groups, key=lambda x: x.encode()):
        groups[name].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r, r["text"])))
        trees[name] = levels([leaf_of(r, r["text"]) for r in groups[name]])
    top = levels([t[-1][0] for t in trees.values()])
    out = []
    for k, (name, tree) in enumerate(trees.items()):
        for at, r in enumerate(groups[name]):
            steps = path(tree, at) + path(top, k)
            text = r["text"]
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 and text is not None:
                text = text.replace("\n", "")
            digest = leaf_of(r, text)
            for before, after in steps:
                digest = sha(before + digest + after)
            root = top[-1][0]
            out.append((r["doc_id"], tree[0][at], tree[-1][0], root, sha("".join(b + a for b, a in steps)), digest, digest == root))
    return out


NAMES = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def rows_of(df):
    return sorted((tuple(r[n] for n in NAMES) for r in df.collect()), key=repr)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 26, 27, 28, 100])
def test_walk_of_one_block(n):
    leaves = [sha(str(k)) for k in range(n)]
    tree = levels(leaves)
    root, steps = walk([bytes.fromhex(x) for x in leaves], levels_of(n))
    assert root.hex() == tree[-1][0]
    for at in range(n):
        assert [(b.hex(), a.hex()) for b, a in steps[at]] == path(tree, at)


def test_nulls_ties_repeats_and_extra_columns(documents):
    rows = [(7, "a\nb", None), (7, "a\nb", None), (None, "x\ny", "é"), (4, None, "é"), (5, "", "z"), (5, "\n", "z"), (5, "long\n" * 50_000, "z"), (1, "q", "zz"), (2, "q\n", "zz"), (3, "w", ""), (9, "w\n", "zz"), (10, "w", "zz")]
    table = documents(rows).withColumns({"leaf": F.lit("mine"), "tree": F.lit(1), "steps": F.lit(2)})
    assert rows_of(merkle.tamper_evidence(table)) == sorted(brute_force([r.asDict() for r in table.collect()]), key=repr)


def test_empty_table_and_one_row(documents):
    assert merkle.tamper_evidence(documents([])).collect() == []
    table = documents([(2, "only\n", "s")])
    assert rows_of(merkle.tamper_evidence(table)) == brute_force([r.asDict() for r in table.collect()])


def test_trees_of_several_traversals(spark):
    # three traversals, blocks that end early, and more groups than a run
    n = BLOCK * ARITY + 2
    ids = spark.range(n + 40).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") < n, "hot").otherwise(F.concat(F.lit("s"), F.col("id").cast("string"))).alias("source"),
        F.lit("en").alias("lang"), F.lit(1).cast("long").alias("n_chars"), F.concat(F.lit("t\n"), F.col("id").cast("string")).alias("text"),
    )
    assert rows_of(merkle.tamper_evidence(ids.repartition(5))) == sorted(brute_force([r.asDict() for r in ids.collect()]), key=repr)


def test_a_proof_shows_any_change(documents):
    table = documents([(k, f"text {k}", f"s{k % 5}") for k in range(60)])
    found = merkle.manifest(table, changed={"lang": F.when(F.col("doc_id") == 33, "de").otherwise(F.col("lang"))})
    wrong = found.where(merkle.folded(F.col("changed"), F.col("steps")) != F.col("root")).collect()
    assert [r["doc_id"] for r in wrong] == [33]


def test_a_whole_table(spark, small):
    table = spark.read.parquet(f"{small}/documents.parquet")
    assert rows_of(merkle.tamper_evidence(table)) == sorted(brute_force([r.asDict() for r in table.collect()]), key=repr)
