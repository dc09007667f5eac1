"""Merkle manifest of a dataset: leaves, subtree and root digests, and a proof for every row.

Leaves are digests of rows, made in the JVM; from then on only digests move. A sort by ranges and counts of its runs give each leaf its
position in its group. Blocks of ``BLOCK`` aligned leaves go to tasks; a task walks its block in postorder: a node's digest is returned,
and while the walk unwinds, the siblings of each child are appended to all leaves below it. The roots of the blocks are the leaves of
the next such traversal, until each group has one root; the groups' roots are traversed in the same way. What the upper traversals found
is joined, block by block, to the proofs of the lower ones.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .shared import materialise

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY = 3
LEVELS = 7
BLOCK = ARITY**LEVELS

STEPS = "array<struct<before: binary, after: binary>>"
_ARROW_STEPS = pa.list_(pa.struct([("before", pa.binary()), ("after", pa.binary())]))


def encoded(value: Column) -> Column:
    """``-`` for a null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(values: list[Column]) -> Column:
    return F.sha2(F.concat(*map(encoded, values)), 256)


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its proof give."""
    hexed = lambda x: F.lower(F.hex(x))
    return F.aggregate(steps, leaf, lambda digest, step: F.sha2(F.concat(hexed(step["before"]), digest, hexed(step["after"])), 256))


def proof_digest(steps: Column) -> Column:
    """The digest of all siblings, level by level, left to right."""
    return F.sha2(F.concat_ws("", F.transform(steps, lambda s: F.lower(F.concat(F.hex(s["before"]), F.hex(s["after"]))))), 256)


def levels_of(n: int) -> int:
    """The height of a tree over ``n`` leaves; of a block, if they are more."""
    height = 0
    while height < LEVELS and ARITY**height < n:
        height += 1
    return height


def walk(digests: list[bytes], height: int) -> tuple[bytes, list[list[tuple[bytes, bytes]]]]:
    """The root of a tree of this height over aligned leaves, and for each leaf the siblings before and after, from below."""
    steps = [[] for _ in digests]

    def visit(level: int, start: int, stop: int) -> bytes:
        if not level:
            return digests[start]
        span = ARITY ** (level - 1)
        places = range(start, stop, span)
        children = [visit(level - 1, at, min(at + span, stop)) for at in places]
        for k, at in enumerate(places):
            step = (b"".join(children[:k]), b"".join(children[k + 1 :]))
            for leaf in range(at, min(at + span, stop)):
                steps[leaf].append(step)
        return hashlib.sha256("".join(c.hex() for c in children).encode()).digest()

    return visit(height, 0, len(digests)), steps


def _blocks(batches):
    """Rows of one block after the other, each block's in order of position; one is held at a time."""
    key, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            now = (row["tree"], row["block"])
            if now != key and rows:
                yield rows
                rows = []
            key = now
            rows.append(row)
    if rows:
        yield rows


def traverse(nodes: DataFrame, kept: str) -> DataFrame:
    """``nodes`` (tree, position, n, digest, and the columns of the schema ``kept``) with block, steps within the block, and, in the block's first row, top."""
    schema = f"tree string, block long, position long, n long, digest binary, {kept}steps {STEPS}, top binary"
    shape = StructType.fromDDL(schema)
    held = {f.name: f.type for f in to_arrow_schema(shape)}
    extra = [f.name for f in shape.fields if f.name not in ("tree", "block", "position", "n", "digest", "steps", "top")]

    def run(batches):
        for rows in _blocks(batches):
            top, steps = walk([r["digest"] for r in rows], levels_of(rows[0]["n"]))
            columns = {name: pa.array([r[name] for r in rows], held[name]) for name in ("tree", "block", "position", "n", "digest", *extra)}
            columns["steps"] = pa.array([[{"before": b, "after": a} for b, a in s] for s in steps], _ARROW_STEPS)
            columns["top"] = pa.array([top] + [None] * (len(rows) - 1), pa.binary())
            yield pa.RecordBatch.from_pydict(columns)

    blocked = nodes.withColumn("block", F.floor(F.col("position") / BLOCK)).select("tree", "block", "position", "n", "digest", *extra)
    return blocked.repartition("tree", "block").sortWithinPartitions("tree", "block", "position").mapInArrow(run, shape)


def positions(nodes: DataFrame, order: list[str], label: str) -> DataFrame:
    """``nodes`` with their position (from 0) by ``order`` in their tree and the number n of its nodes.

    Sorted by ranges of tree and order, so that a tree of any size is spread; where the runs of a tree start follows from their lengths. A
    window sees one row for each partition that a tree reaches into.
    """
    placed = nodes.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order).withColumn("_id", F.monotonically_increasing_id())
    placed = materialise(placed.withColumn("_part", F.shiftright("_id", 33)), label)
    runs = placed.groupBy("tree", "_part").agg(F.min("_id").alias("_first"), F.count("*").alias("_length"))
    tree = Window.partitionBy("tree")
    before = F.sum("_length").over(tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("tree", "_part", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_length").over(tree).alias("n"))
    return placed.join(runs, ["tree", "_part"]).withColumn("position", F.col("_id") + F.col("_shift")).drop("_id", "_part", "_shift")


def _tops(traversed: DataFrame) -> DataFrame:
    return traversed.where("top is not null").select("tree", F.col("block").alias("position"), F.ceil(F.col("n") / BLOCK).alias("n"), F.col("top").alias("digest"))


def settle(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((tree, position, steps) of all nodes up to their tree's root, (tree, digest) of the roots), traversal by traversal."""
    none = F.array().cast(STEPS)
    single = nodes.where("n = 1")
    done, roots = single.select("tree", "position", none.alias("steps")), single.select("tree", "digest")
    rest = nodes.where("n > 1")
    if rest.isEmpty():
        return done, roots
    lower = materialise(traverse(rest, ""), "blocks")
    upper, more = settle(_tops(lower))
    return done.unionByName(_lifted(lower, upper).select("tree", "position", "steps")), roots.unionByName(more)


def _lifted(lower: DataFrame, upper: DataFrame) -> DataFrame:
    """Proofs within blocks, followed by those of the blocks; other columns of ``upper`` come along."""
    above = upper.withColumnsRenamed({"position": "block", "steps": "_above"})
    return lower.join(above, ["tree", "block"]).withColumn("steps", F.concat("steps", "_above")).drop("_above")


def manifest(rows: DataFrame, fields=FIELDS, group: str = "source", order: str = "doc_id", changed: dict[str, Column] | None = None) -> DataFrame:
    """(``order``, leaf, subroot, root, steps) of every row; with ``changed`` also changed, the leaf with these fields in place of its own.

    A leaf is the SHA-256 of its encoded ``fields``. In each group leaves ascend by ``order``, then by digest; every three consecutive nodes
    become the digest of their concatenated hexadecimal digests, a last run of fewer or one too, while there are several. Roots of
    groups, a null group first and then by UTF-8 bytes, give the root in the same way. ``steps``: for each level from the leaf the
    digests before and after it in its run, as bytes; ``folded`` takes them.

    Null fields are encoded as ``-``, so they differ from empty texts; a null in ``order`` comes first. Rows of equal ``order`` and digest are
    alike, so it doesn't matter which comes first. Texts of any length count whole. An empty table gives no rows; other columns take no part.
    """
    values = lambda other: [other.get(f, F.col(f)) for f in fields]
    leaves = rows.select(
        F.coalesce(F.concat(F.lit("+"), F.col(group).cast("string")), F.lit("")).alias("tree"),
        F.col(order).cast("long").alias("key"),
        F.unhex(leaf_digest(values({}))).alias("digest"),
        (F.unhex(leaf_digest(values(changed))) if changed else F.lit(None).cast("binary")).alias("changed"),
    )
    leaves = positions(materialise(leaves, "leaves"), ["key", "digest"], "sorted-leaves")
    lower = materialise(traverse(leaves, "key long, changed binary, "), "leaf-blocks")
    upper, subroots = settle(_tops(lower))
    subroots = materialise(subroots, "subroots")
    trees = positions(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), ["name"], "trees")
    above, root = settle(trees.drop("name"))
    known = trees.join(above, ["tree", "position"]).join(root.select("tree", F.col("digest").alias("root")), "tree")
    known = known.select(F.col("name").alias("tree"), F.col("digest").alias("subroot"), "root", F.col("steps").alias("_last"))
    blocks = upper.join(known, "tree").withColumn("steps", F.concat("steps", "_last")).drop("_last")
    hexed = lambda name: F.lower(F.hex(name)).alias(name)
    out = _lifted(lower, blocks).withColumn("leaf", F.col("digest"))
    return out.select(F.col("key").alias(order), hexed("leaf"), hexed("subroot"), hexed("root"), "steps", *([hexed("changed")] if changed else []))


def tamper_evidence(documents: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row.

    Where 2 divides the CRC-32 of the decimal doc_id, the text loses its line breaks before the proof is checked; a null text or doc_id is
    left as it is, and a text without line breaks verifies. Ties, nulls and empty tables: see ``manifest``.
    """
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    text = F.when(chosen, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    found = manifest(documents, changed={"text": text})
    back = folded(F.col("changed"), F.col("steps"))
    return found.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("steps")).alias("proof_sha256"), back.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))
