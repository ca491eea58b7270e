"""A trie of conversation prefixes: which turns conversations share, and what sharing them saves.

A burst trie over turn ids. The trie's heads hold containers of conversation suffixes. Containers with more
turns than ``CAP`` burst: their suffixes are dealt to new containers by the next turn id, and a head takes
the container's place. A round bursts twice as many turns deep as the one before, so suffixes that share a
long run need few rounds. What remains is small: a container's suffixes are sorted and swept into nodes by
one task, and one with a single suffix is a chain of nodes that needs no gathering.

Heads are never gathered: what they count is summed over their conversations, from each conversation's
first node of its own. Turns are known by half of their SHA-256, and a prefix by two 64-bit sums (XOR) of
hashes of its turns at their depths, which windows take in blocks of ``BLOCK`` turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketloom.llm.common import placed, written

CAP, BLOCK = 1024, 1024
NODES = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
NONE = hashlib.sha256(b"").hexdigest()


def turn_rows(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, turn, bytes) of each turn, as a written table: its place from 0, id, and UTF-8 bytes of its text.

    Order is by turn, null first, ties by turn id; repeated rows are turns like any other. Null roles and texts
    are empty. Rows without a conv_id belong to no conversation and are left out.
    """
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    key = F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").alias("_turn"), key.alias("turn"), F.octet_length(text).cast("bigint").alias("bytes"))
    return written(placed(rows, "conv_id", "_turn", "turn").select("conv_id", "pos", "turn", "bytes"))


def with_shared_openings(turns: DataFrame, opening: Column, most: int, leader: Column) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id, len) and their turns (conv_id, depth from 1, turn, bytes, len), each opened like another.

    The first ``opening`` turns (``most`` at most) of a conversation give way to those of ``leader``: all that
    it has if fewer, none if there is no such conversation. Both are expressions of conv_id.
    """
    convs = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).select("conv_id", "n", opening.alias("h"), leader.alias("leader"))
    sizes = convs.select(F.col("conv_id").alias("_conv"), F.col("n").alias("_n"))
    led = F.least(F.col("h"), F.coalesce("_n", F.lit(0)))
    convs = written(convs.join(sizes, F.col("leader") == F.col("_conv"), "left").select("conv_id", "h", "leader", led.alias("k"), (led + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len")))
    own = turns.join(convs, "conv_id").where("pos >= h").select("conv_id", (F.col("k") + F.col("pos") - F.col("h") + 1).alias("depth"), "turn", "bytes", "len")
    heads = turns.where(F.col("pos") < most).withColumnRenamed("conv_id", "leader")
    opened = convs.where("k > 0").join(heads, "leader").where("pos < k").select("conv_id", (F.col("pos") + 1).alias("depth"), "turn", "bytes", "len")
    return convs.select("conv_id", "len"), own.union(opened)


def _prefixes(turns: DataFrame) -> DataFrame:
    """Adds p and q, which stand for the prefix that ends with the turn, and ``before``, the bytes of the turns before it; written."""
    rows = turns.select("*", F.expr(f"(depth - 1) div {BLOCK}").alias("block"), F.xxhash64("turn", "depth", F.lit(1)).alias("x"), F.xxhash64("turn", "depth", F.lit(2)).alias("y"))
    inside = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("conv_id", "depth", "bytes", "turn", "len", "block", "x", "y", F.bit_xor("x").over(inside).alias("_p"), F.bit_xor("y").over(inside).alias("_q"), (F.sum("bytes").over(inside) - F.col("bytes")).alias("_b"))
    # Only what is longer than a block has sums to carry over.
    totals = rows.where(F.col("len") > BLOCK).groupBy("conv_id", "block").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"), F.sum("bytes").alias("bytes"))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = written(totals.select(F.col("conv_id").alias("_conv"), F.col("block").alias("_block"), F.bit_xor("x").over(earlier).alias("_x"), F.bit_xor("y").over(earlier).alias("_y"), F.sum("bytes").over(earlier).alias("_bytes")).where("_block > 0"))
    rows = rows.join(carried, (F.col("conv_id") == F.col("_conv")) & (F.col("block") == F.col("_block")), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint"))
    return written(rows.select("conv_id", "depth", "turn", "bytes", "len", F.col("_p").bitwiseXOR(zero("_x")).alias("p"), F.col("_q").bitwiseXOR(zero("_y")).alias("q"), (F.col("_b") + zero("_bytes")).alias("before")))


def _burst(prefixes: DataFrame, root: DataFrame, cap: int) -> DataFrame:
    """(conv_id, depth, rep, n, big, parent, len, before): each conversation's place in every head it passes, and in the container that it ends up in.

    ``rep`` is the smallest conversation of that prefix, with the depth its name; ``n`` how many it has; ``big``
    whether it is a head; ``parent`` the rep of the prefix that is a turn shorter.
    """
    found, depth, width = root, 0, 1
    live = root.select("conv_id", "rep")
    while True:
        rows = prefixes.where((F.col("depth") > depth) & (F.col("depth") <= depth + width)).join(live.select("conv_id"), "conv_id", "left_semi")
        sizes = written(rows.groupBy("depth", "p", "q").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("len") - F.col("depth") + 1).alias("size"), F.min("conv_id").alias("rep")))
        big = (F.col("size") > cap) & (F.col("n") > 1)
        there = written(rows.join(sizes, ["depth", "p", "q"]).select("conv_id", "depth", "rep", "n", big.alias("big"), "len", "before"))
        above = there.where("big").select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("rep").alias("parent")).union(live.select("conv_id", F.lit(depth + 1).cast("bigint"), "rep"))
        there = written(there.join(above, ["conv_id", "depth"]).select(*root.columns))
        found, depth, width = found.union(there), depth + width, 2 * width
        live = there.where((F.col("depth") == depth) & F.col("big") & (F.col("len") > depth)).select("conv_id", "rep")
        if live.isEmpty():
            return found


def _swept(suffixes: DataFrame) -> DataFrame:
    """Nodes, with ``before`` of their rep, of containers: rows (rep, conv_id, depth, turn, bytes, before, parent), at most ``CAP`` for each rep."""
    schema = f"{NODES}, before bigint"
    columns = [f.split()[0] for f in schema.split(", ")]

    def nodes_of(parent: int, top: int, members: dict[int, list[tuple[bytes, int, int]]]) -> list[tuple]:
        nodes, path, last = [], [], []
        for turns, conv in sorted(([t for t, _, _ in said], c) for c, said in members.items()):
            same = next((i for i, (a, b) in enumerate(zip(turns, last, strict=False)) if a != b), min(len(turns), len(last)))
            del path[same:]
            for i in range(len(turns)):
                if i == len(path):
                    # parent's place, depth, rep, convs, children, leaves, saved, ends, bytes of the last text
                    nodes.append([path[-1] if path else -1, i, conv, 0, 0, 0, 0, [], members[conv][i][1]])
                    path.append(len(nodes) - 1)
                    if i:
                        nodes[path[-2]][4] += 1
                node = nodes[path[i]]
                node[2], node[3] = min(node[2], conv), node[3] + 1
            nodes[path[-1]][7].append(conv)
            last = turns
        # Children come after their parents.
        for node in reversed(nodes):
            node[5] = node[5] or 1
            node[6] += (node[3] - 1) * node[8]
            if node[0] >= 0:
                nodes[node[0]][5] += node[5]
                nodes[node[0]][6] += node[6]
        ends = lambda x: hashlib.sha256(",".join(map(str, sorted(x))).encode()).hexdigest()
        return [(rep, top + i, nodes[up][2] if up >= 0 else parent, n, kids, leaves, saved, ends(at), members[rep][i][2]) for up, i, rep, n, kids, leaves, saved, at, _ in nodes]

    def sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, members = None, {}
        for b in batches:
            out = []
            for rep, conv, depth, turn, size, before, parent in zip(*[b[c] for c in ("rep", "conv_id", "depth", "turn", "bytes", "before", "parent")], strict=True):
                if here is None or rep != here[0]:
                    if here:
                        out += nodes_of(here[1], here[2], members)
                    here, members = (rep, parent, depth), {}
                members.setdefault(conv, []).append((turn, size, before))
            if out:
                yield pd.DataFrame(out, columns=columns)
        if here:
            yield pd.DataFrame(nodes_of(here[1], here[2], members), columns=columns)

    return suffixes.repartition("rep").sortWithinPartitions("rep", "conv_id", "depth").mapInPandas(sweep, schema)


def _digests_of_ends(ends: DataFrame) -> DataFrame:
    """(rep, depth, ends_sha256) of (rep, depth, conv_id): a digest reads all ids in order, so tasks join theirs to long texts first."""
    by = ["rep", "depth", "conv_id"]
    rows = written(ends.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id()))
    ids = F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string"))
    parts = rows.groupBy("rep", "depth", F.shiftright("at", 12).alias("part")).agg(F.array_join(ids, ",").alias("ids"))
    said = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "ids"))), lambda s: s.ids), ",")
    return parts.groupBy("rep", "depth").agg(F.sha2(said, 256).alias("ends_sha256"))


def prefix_trie(convs: DataFrame, turns: DataFrame, cap: int = CAP) -> DataFrame:
    """A row for each prefix of the conversations: ``NODES``.

    ``convs``: conv_id (bigint, distinct, no nulls) and len, which may be 0; ``turns``: conv_id, depth (1 to
    len), turn (an id), bytes, len. A node is known by conv_id, the smallest of its members, and depth; the root
    has depth 0 and no parent. n_leaves and saved_tokens (bytes that equal prefixes needn't repeat) are of the
    node's whole subtree; ends_sha256 is of the members that end there. The root is always a head. Without
    conversations there are no nodes. Turns of any length are just numbers here.
    """
    whole = convs.agg(F.min("conv_id").alias("rep"), F.count(F.lit(1)).alias("n")).first()
    if not whole.n:
        return convs.sparkSession.createDataFrame([], NODES)
    none = F.lit(None).cast("bigint")
    root = convs.select("conv_id", F.lit(0).cast("bigint").alias("depth"), F.lit(whole.rep).alias("rep"), F.lit(whole.n).alias("n"), F.lit(True).alias("big"), none.alias("parent"), "len", F.lit(0).cast("bigint").alias("before"))
    prefixes = _prefixes(turns)
    places = _burst(prefixes, root, cap)
    firsts = places.where("conv_id = rep")
    rest = places.where("NOT big").select("conv_id", F.col("depth").alias("top"), "rep", "n", "parent")

    alone = prefixes.join(rest.where("n = 1"), "conv_id").where("depth >= top")
    chains = alone.select(
        "conv_id", "depth", F.when(F.col("depth") == F.col("top"), F.col("parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"), F.lit(1).cast("bigint").alias("n_convs"), (F.col("depth") < F.col("len")).cast("bigint").alias("n_children"),
        F.lit(1).cast("bigint").alias("n_leaves"), F.lit(0).cast("bigint").alias("saved_tokens"), F.when(F.col("depth") == F.col("len"), F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(NONE).alias("ends_sha256"),
    )
    swept = written(_swept(prefixes.join(rest.where("n > 1"), "conv_id").where("depth >= top").select("rep", "conv_id", "depth", "turn", "bytes", "before", "parent")))

    kids = firsts.where("depth > 0").groupBy(F.col("parent").alias("rep"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"))
    heads = written(firsts.where("big").join(kids, ["rep", "depth"], "left").select("rep", "depth", "parent", "n", "before", F.coalesce("n_children", F.lit(0)).alias("n_children")))

    # From its first own node on, a conversation saves nothing that a smaller one hasn't paid for.
    marks = swept.select("conv_id", "before", (F.col("n_children") == 0).alias("leaf"))
    marks = marks.union(heads.select("rep", "before", F.col("n_children") == 0)).union(firsts.where("NOT big").select("conv_id", "before", F.col("n") == 1))
    marks = marks.groupBy("conv_id").agg(F.min("before").alias("own"), F.max("leaf").alias("leaf"))
    totals = turns.groupBy("conv_id").agg(F.sum("bytes").alias("total"))
    passed = places.where("big").join(written(totals.join(marks, "conv_id", "full")), "conv_id", "left")
    own = F.greatest(F.coalesce("own", "total", F.lit(0)), F.col("before"))
    sums = passed.groupBy("rep", "depth").agg(F.sum(F.coalesce(F.col("leaf"), F.lit(False)).cast("bigint")).alias("n_leaves"), F.sum(own - F.col("before")).alias("saved_tokens"))
    ends = _digests_of_ends(places.where("big AND len = depth").select("rep", "depth", "conv_id"))
    top = heads.join(sums, ["rep", "depth"]).join(ends, ["rep", "depth"], "left")
    top = top.select(F.col("rep").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NONE)).alias("ends_sha256"))
    return top.union(chains).union(swept.drop("before"))
