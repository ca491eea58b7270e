"""Merkle manifest of a dataset: a digest for each row, a tree for each group of rows, and one root over the groups.

Trees grow by self-joins. At each level every node looks its siblings up by their computed index (the
index XOR 1 in a binary tree, else its slot's offsets within its run of ``width`` nodes), in equijoins on
tree and index, and the nodes in slot zero emit the parents. All groups grow at the same time, and keys of
joins are unique, so a group with a third of all rows is dealt out like any other. Proofs go back down:
each level joins its nodes to their parents and puts its own siblings before the parent's.

Digests are SHA-256. What is hashed is text: inputs joined, digests as lower-case hex.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketloom.llm.common import placed, written

WIDTH = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEP = "array<struct<before:binary,after:binary>>"


def hexed(c: Column) -> Column:
    return F.lower(F.hex(c))


def digest(c: Column) -> Column:
    """SHA-256 of text."""
    return F.unhex(F.sha2(c, 256))


def leaf(fields: dict[str, Column] | None = None) -> Column:
    """A row's digest over ``FIELDS``: each as ``-`` if null, else its UTF-8 byte count, a colon and itself. ``fields`` replaces columns."""

    def said(name: str) -> Column:
        value = (fields or {}).get(name, F.col(name)).cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return digest(F.concat(*map(said, FIELDS)))


def _siblings(nodes: DataFrame, width: int) -> DataFrame:
    """Adds ``before`` and ``after``: the joined digests of the node's siblings on its left and right."""
    slot = F.pmod("idx", F.lit(width))
    others = nodes.select(F.col("tree").alias("_tree"), F.col("idx").alias("_idx"), F.col("digest").alias("_digest"))
    df, found = nodes, []
    for k in range(1, width):
        at = F.col("idx").bitwiseXOR(F.lit(1)) if width == 2 else F.col("idx") - slot + F.pmod(slot + k, F.lit(width))
        side = others.select(*[F.col(c).alias(f"{c}{k}") for c in others.columns])
        df = df.join(side, (F.col("tree") == F.col(f"_tree{k}")) & (at == F.col(f"_idx{k}")), "left")
        found.append(F.struct(F.col(f"_idx{k}").alias("idx"), F.col(f"_digest{k}").alias("digest")))
    there = F.sort_array(F.filter(F.array(*found), lambda s: s.idx.isNotNull()))
    joined = lambda side: F.aggregate(F.filter(there, side), F.lit(b""), lambda a, s: F.concat(a, s.digest))
    return df.select(*[nodes[c] for c in nodes.columns], joined(lambda s: s.idx < F.col("idx")).alias("before"), joined(lambda s: s.idx > F.col("idx")).alias("after"))


def grow(nodes: DataFrame, width: int = WIDTH) -> list[DataFrame]:
    """The levels of trees over ``nodes`` (tree, idx from 0, n, digest, and others), leaves first, each with ``before`` and ``after``.

    ``n`` is how many nodes the tree has at that level; where it is 1 the node is the tree's root and has no
    siblings to look up. There are as many levels as the largest tree needs; each is a written table.
    """
    levels, most = [], nodes.agg(F.max("n")).first()[0] or 1
    while True:
        open_, done = _siblings(nodes.where("n > 1"), width), nodes.where("n = 1")
        level = written(open_.unionByName(done.withColumns({"before": F.lit(None).cast("binary"), "after": F.lit(None).cast("binary")})))
        levels.append(level)
        if most <= 1:
            return levels
        most = -(-most // width)
        first = level.where((F.col("n") > 1) & (F.pmod("idx", F.lit(width)) == 0))
        up = digest(hexed(F.concat("digest", "after")))
        nodes = first.select("tree", F.expr(f"idx div {width}").alias("idx"), F.expr(f"(n + {width - 1}) div {width}").alias("n"), up.alias("digest"))


def prove(levels: list[DataFrame], roots: Callable[[DataFrame], DataFrame], carry: list[str], width: int = WIDTH) -> DataFrame:
    """The leaves with ``path``, their siblings level by level, and the columns ``carry`` of their tree.

    ``roots`` gives (tree, idx, path, *carry) for the root nodes of a level; ``path`` is what comes above them.
    """
    above = None
    for level in reversed(levels):
        known = roots(level.where("n = 1")).select(*[F.col(c).alias(f"_{c}") for c in ("tree", "idx", "path", *carry)])
        paths = known.withColumn("_own", F.lit(True))
        if above is not None:
            paths = paths.union(above.select("tree", "idx", "path", *carry, F.lit(False)))
        # A root is joined to its own row, any other node to its parent's.
        on = (F.col("tree") == F.col("_tree")) & (F.when(F.col("n") == 1, F.col("idx")).otherwise(F.expr(f"idx div {width}")) == F.col("_idx")) & ((F.col("n") == 1) == F.col("_own"))
        step = F.array(F.struct("before", "after")).cast(STEP)
        path = F.when(F.col("n") == 1, F.col("_path")).otherwise(F.concat(step, F.col("_path")))
        made = {"path", *carry}
        above = level.join(paths, on).select(*[level[c] for c in level.columns if c not in ("before", "after", *made)], path.alias("path"), *[F.col(f"_{c}").alias(c) for c in carry])
    return above


def manifest(docs: DataFrame, leaf_hash: Column, group: str = "source", order: str = "doc_id", keep: tuple[str, ...] = (), width: int = WIDTH) -> DataFrame:
    """One row for each of ``docs``: the columns ``keep``, leaf, subroot, root and ``path``.

    Leaves of a group ascend by ``order`` (null first), ties by leaf; equal rows are leaves of their own.
    While a group has several nodes, each run of ``width`` of them (the last may be shorter, even one) becomes
    a parent; what remains is the group's subroot. Subroots, ordered by group (null first, bytewise), become
    the root likewise. ``path`` holds a leaf's siblings on the left and right, level by level, up to the root.
    Rows with a null group form one group, before that of the empty string. Null and empty texts of any length
    only matter through ``leaf_hash``. An empty table gives no rows. Columns not in ``keep`` are left out, so
    their names don't matter.
    """
    named = {c: f"kept_{i}" for i, c in enumerate(keep)}
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    rows = docs.select(F.coalesce(F.concat(F.lit("s"), quoted(group).cast("string")), F.lit("")).alias("tree"), quoted(order).alias("_order"), leaf_hash.alias("digest"), *[quoted(c).alias(n) for c, n in named.items()])
    rows = placed(rows, "tree", "_order", "digest")
    sizes = written(rows.groupBy(F.col("tree").alias("_of")).agg(F.count(F.lit(1)).alias("n")))
    leaves = rows.withColumnRenamed("pos", "idx").join(sizes, F.col("tree") == F.col("_of")).select("tree", "idx", "n", "digest", *named.values())
    levels = grow(leaves, width)

    # The trees' roots are the leaves of one more tree.
    subroots = levels[0].where("n = 1").select("tree", "digest")
    for level in levels[1:]:
        subroots = subroots.union(level.where("n = 1").select("tree", "digest"))
    top = placed(subroots.select(F.lit("").alias("top"), F.col("tree").alias("of"), "digest"), "top", "of")
    n = top.count()
    tops = grow(top.select(F.col("top").alias("tree"), F.col("pos").alias("idx"), F.lit(n).cast("bigint").alias("n"), "digest", "of"), width)
    proofs = prove(tops, lambda x: x.select("tree", "idx", F.array().cast(STEP).alias("path"), F.col("digest").alias("root")), ["root"], width)
    proofs = written(proofs.select(F.col("of").alias("_of"), F.col("path").alias("_above"), "root"))
    out = prove(levels, lambda x: x.join(proofs, F.col("tree") == F.col("_of")).select("tree", "idx", F.col("_above").alias("path"), F.col("digest").alias("subroot"), "root"), ["subroot", "root"], width)
    return out.select(*[F.col(n).alias(c) for c, n in named.items()], F.col("digest").alias("leaf"), "subroot", "root", "path")


def folded(leaf_hash: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to; it is the manifest's if none of them was changed."""
    return F.aggregate(path, leaf_hash, lambda a, s: digest(hexed(F.concat(s.before, a, s.after))))


def proof_digest(path: Column) -> Column:
    """SHA-256 in hex of all siblings on a path, from the leaf up, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: hexed(F.concat(s.before, s.after))), ""), 256)
