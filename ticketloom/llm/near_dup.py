"""MinHash near-duplicates: one-permutation hashing, banded buckets, star-shaped candidates, exact links.

Every text becomes its set of word shingles; texts with equal sets form a class and only one text of a
class is searched. One-permutation hashing with optimal densification gives a signature, and bands of it
give buckets. In each bucket the class with the smallest hash is the centre of a star, so pairs grow with
the size of a bucket and not with its square. Candidate pairs are confirmed on the full sets. Where a
bucket holds classes that are not linked after that, they are joined exactly, by their rare shingles, so
that no link between components is lost.

With 32 bands of 4, a pair at similarity 0.75 shares no bucket with probability 5e-6, less above.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticketloom.llm.common import boxed, dropped, few, forget, written

WORDS, BANDS, ROWS, CENTRES, BITS, SALTS = 5, 32, 4, 64, 2048, 32
MORE_THAN = 75  # percent
#: Words whose hashes a task remembers, and texts whose sets it hands on together; both bound its memory alone.
REMEMBERED, TOGETHER = 1 << 16, 256


class _Hashes(dict):
    """64-bit hashes of words; the first ``REMEMBERED`` are kept, which the frequent words are among."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = xxhash.xxh64_intdigest(word)
        if len(self) < REMEMBERED:
            self[word] = value
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, hashes: dict[bytes, int], words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; with fewer words one for them all, with none none."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    h = np.array([hashes[w] for w in parts], np.uint64)
    n = min(words, len(h))
    s = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        s = s * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k]
    return np.unique(_mixed(s))


def _probes(bins: int) -> np.ndarray:
    """For each bin the order in which others are asked for a value, itself first."""
    rng = np.random.default_rng(17)
    return np.array([[i, *rng.permutation([j for j in range(bins) if j != i])] for i in range(bins)])


def signature(s: np.ndarray, probes: np.ndarray) -> np.ndarray:
    """The smallest hash of each bin; empty bins take that of the first non-empty one in their order."""
    bins = len(probes)
    at = (s >> np.uint64(64 - int(bins).bit_length() + 1)).astype(np.int64)
    filled, first = np.unique(at, return_index=True)
    low, has = np.zeros(bins, np.uint64), np.zeros(bins, bool)
    low[filled], has[filled] = s[first], True
    return low[probes[np.arange(bins), has[probes].argmax(1)]]


def bitmap(s: np.ndarray) -> np.ndarray:
    """One bit for each hash value modulo ``BITS``: two sets differ in at least as many members as their bitmaps in bits."""
    bits = np.zeros(BITS, np.uint8)
    bits[(s & np.uint64(BITS - 1)).astype(np.int64)] = 1
    return np.packbits(bits).view(np.int64)


def _searched(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, text hash, number of shingles, class (null without words) and band keys of each row."""
    schema = "doc_id bigint, _th bigint, n_shingles bigint, class binary, bands array<bigint>"
    rows = docs.select(F.col("doc_id").cast("bigint"), F.xxhash64("text").alias("_th"), "text")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        hashes, probes = _Hashes(), _probes(BANDS * ROWS)
        salt = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)
        for b in batches:
            n, cls, bands = [], [], []
            for text in b.column("text"):
                s = shingles(text.as_py(), hashes, words)
                n.append(len(s))
                cls.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                if len(s):
                    rows_of, key = signature(s, probes).reshape(BANDS, ROWS), salt
                    for k in range(ROWS):
                        key = _mixed(key + rows_of[:, k])
                    bands.append(key.view(np.int64))
                else:
                    bands.append(None)
            # Ids stay in Arrow, so that they are exact also next to nulls.
            made = [pa.array(n, pa.int64()), pa.array(cls, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("_th"), *made], ["doc_id", "_th", "n_shingles", "class", "bands"])

    return rows.mapInArrow(search, schema)


def _sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """class, full set and a bitmap of it for the representative texts in ``wanted`` (doc_id, _th, class)."""

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget()
        hashes = _Hashes()
        for b in (batch[k : k + TOGETHER] for batch in batches for k in range(0, len(batch), TOGETHER)):
            found = [shingles(t, hashes, words) for t in b["text"]]
            yield pd.DataFrame({"class": b["class"].array, "set": [s.view(np.int64) for s in found], "bits": [bitmap(s) for s in found]})

    rows = docs.select(F.col("doc_id").cast("bigint").alias("_d"), F.xxhash64("text").alias("_h"), "text")
    # A representative may be repeated row by row; one of the equal rows is enough.
    found = rows.join(wanted, F.col("_d").eqNullSafe(F.col("doc_id")) & (F.col("_h") == F.col("_th")))
    return found.select("class", "text").mapInPandas(sets, "class binary, set array<bigint>, bits array<bigint>").dropDuplicates(["class"])


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    left, right = sets.select(F.col("class").alias("a"), F.col("set").alias("_a")), sets.select(F.col("class").alias("b"), F.col("set").alias("_b"))
    both = F.size(F.array_intersect("_a", "_b"))
    return pairs.join(left, "a").join(right, "b").where(100 * both >= percent * (F.size("_a") + F.size("_b") - both)).select("a", "b")


def _by_rare_shingles(left: DataFrame, reps: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """All links between classes of ``left`` (class, label) with different labels.

    Shingles are ordered from rare to frequent. Two sets that are similar enough share one among the first
    ``n - ceil(percent * n) + 1`` of either, so classes meet in the buckets of those alone; passages that
    many texts have are frequent and mostly come later. Classes of one bucket take turns as centres,
    ``CENTRES`` at a time, until each has been one.
    """
    sets = sets_of(reps.join(left.select("class"), "class", "left_semi"))
    rows = sets.select("class", F.size("set").alias("n"), F.explode("set").alias("key"))
    # Tables that are joined to many rows of one key are written first, so that Spark can split those rows.
    df = written(rows.groupBy("key").agg(F.count(F.lit(1)).alias("df")).where("df > 1"))
    rare = rows.join(df, "key", "left").groupBy("class", "n").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("df", F.lit(1)).alias("df"), "key"))).alias("_s"))
    need = F.ceil(F.col("n") * percent / 100.0 - 1e-9).cast("int")
    keyed = rare.select("class", "n", F.posexplode(F.slice("_s", F.lit(1), F.col("n") - need + 1)).alias("at", "_s")).where("_s.df > 1").select("class", "n", "at", F.col("_s.key").alias("key"))
    bits = sets.select("class", F.struct(*[F.col("bits")[i].alias(f"b{i}") for i in range(BITS // 64)]).alias("bits"))
    keyed, labels = written(keyed.join(bits, "class")), left
    dropped(df)
    n = keyed.count()
    links, tested, first, centres = None, None, 0, CENTRES
    step = lambda n: F.floor(F.log(n.cast("double")) / math.log(1.05)).cast("int")
    while True:
        known = few(keyed.join(labels, "class"), n)
        mixed = written(known.groupBy("key").agg(F.min("label").alias("_lo"), F.max("label").alias("_hi"), F.count(F.lit(1)).alias("_m")).where((F.col("_lo") != F.col("_hi")) & (F.col("_m") > first + 1)).select("key"))
        ranked = written(few(_ranked(few(known.join(mixed, "key", "left_semi"), n), n), n))
        c = ranked.where((F.col("rank") > first) & (F.col("rank") <= first + centres)).select("key", F.col("class").alias("a"), F.col("n").alias("_n"), F.col("label").alias("_l"), F.col("rank").alias("_r"), F.col("at").alias("_at"), F.col("bits").alias("_b"))
        # Sizes that a partner of a centre can have, given what can be shared from here on, in steps of 5 %.
        most = F.floor(((100 + percent) * (F.col("_n") - F.col("_at")) - percent * F.col("_n")) / percent)
        least = F.ceil(F.col("_n") * percent / 100.0 - 1e-9)
        c = c.where(most >= least).withColumn("step", F.explode(F.sequence(step(least), step(most))))
        # Bits in which two bitmaps differ bound the members that are not shared from below.
        apart = reduce(add, [F.bit_count(F.col(f"bits.b{i}").bitwiseXOR(F.col(f"_b.b{i}"))) for i in range(BITS // 64)])
        fits = (F.col("label") != F.col("_l")) & (100 * F.least("n", "_n") >= percent * F.greatest("n", "_n"))
        # At the first shingle that two sets share, no more than what follows it in either can be shared.
        fits = fits & ((100 + percent) * F.least(F.col("n") - F.col("at"), F.col("_n") - F.col("_at")) >= percent * (F.col("n") + F.col("_n")))
        fits = fits & ((100 + percent) * apart <= (100 - percent) * (F.col("n") + F.col("_n")))
        pairs = ranked.withColumn("step", step(F.col("n"))).join(c, ["key", "step"]).where((F.col("rank") > F.col("_r")) & fits).select("a", F.col("class").alias("b")).distinct()
        pairs = written(few(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), n))
        found = written(few(_confirmed(pairs, sets, percent), n))
        tested, links = (pairs, found) if links is None else (tested.union(pairs), links.union(found))
        first, centres = first + centres, 4 * centres
        done = not ranked.where(F.col("rank") > first).limit(1).count()
        dropped(mixed, ranked)
        if done:
            dropped(keyed, sets)
            return links
        # What is linked by now needs no further test. All links are gone through, so all first labels take part.
        joined = components(left.select(F.col("label").alias("class")).distinct(), _between(links, left), n + 2 * links.count())
        labels = written(left.join(joined.select(F.col("class").alias("label"), F.col("label").alias("_new")), "label").select("class", F.col("_new").alias("label")))


def _ranked(rows: DataFrame, n: int) -> DataFrame:
    """Adds ``rank``, the place of a class among those of its key: first within one of ``SALTS`` parts of the key, then after the parts before. ``n``: how many rows there are at most."""
    parted = rows.withColumn("_part", F.pmod(F.xxhash64("class"), F.lit(SALTS)))
    sizes = few(parted.groupBy("key", "_part").agg(F.count(F.lit(1)).alias("_size")), n)
    before = F.coalesce(F.sum("_size").over(Window.partitionBy("key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = parted.withColumn("_rank", F.row_number().over(Window.partitionBy("key", "_part").orderBy("class")))
    return within.join(sizes.select("key", "_part", before.alias("_before")), ["key", "_part"]).withColumn("rank", (F.col("_before") + F.col("_rank")).cast("int")).drop("_part", "_rank", "_before")


def _between(links: DataFrame, labels: DataFrame) -> DataFrame:
    """Links of classes as links of their labels."""
    a, b = labels.select(F.col("class").alias("a"), F.col("label").alias("_a")), labels.select(F.col("class").alias("b"), F.col("label").alias("_b"))
    return links.join(a, "a").join(b, "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))


def components(nodes: DataFrame, links: DataFrame, rows: int | None = None) -> DataFrame:
    """class and label (the smallest class reachable), by passing labels along links and jumping to a label's label.

    ``rows``: about how many nodes and links there are, if that is known.
    """
    n = nodes.count() + 2 * links.count() if rows is None else rows
    both = written(few(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), n))
    labels = at = written(few(nodes.select("class", F.col("class").alias("label")), n))
    while True:
        near = few(both.join(labels.select(F.col("class").alias("a"), "label"), "a"), n).groupBy(F.col("b").alias("class")).agg(F.min("label").alias("_near"))
        passed = few(labels.join(near, "class", "left").select("class", F.least("label", "_near").alias("_l"), F.col("label").alias("_old")), n)
        jump = labels.select(F.col("class").alias("_l"), F.col("label").alias("_far"))
        new = at = written(few(passed.join(jump, "_l", "left").select("class", F.least("_l", "_far").alias("label"), "_old"), n), at)
        if not new.where(F.col("label") != F.col("_old")).limit(1).count():
            dropped(both)
            return new.select("class", "label")
        labels = new.select("class", "label")


def linked(docs: DataFrame, percent: int = MORE_THAN, words: int = WORDS) -> DataFrame:
    """doc_id, _th (hash of the text), n_shingles, class (null without words), component_id and lead (the first row of the component by id and text hash)."""
    rows = written(_searched(docs, words))
    by_id = F.struct(F.col("doc_id").isNull(), "doc_id", "_th")
    classes = written(rows.where(F.col("class").isNotNull()).groupBy("class").agg(F.min("doc_id").alias("low"), F.min(by_id).alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")))
    keyed = classes.select("class", "n", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("_m"), F.min(F.struct("class", "n")).alias("_c")).where("_m > 1")
    members = written(keyed.join(shared, "key").select("key", "class", "n", F.col("_c.class").alias("centre"), F.col("_c.n").alias("centre_n")))
    fits = lambda x, y: 100 * F.least(x, y) >= percent * F.greatest(x, y)
    star = members.where((F.col("class") != F.col("centre")) & fits(F.col("n"), F.col("centre_n"))).select(F.col("centre").alias("a"), F.col("class").alias("b"))
    tested = written(star.distinct())
    size = members.count()
    nodes = members.select("class").distinct()
    reps = classes.select("class", F.col("rep.doc_id").alias("doc_id"), F.col("rep._th").alias("_th"))

    def confirm(pairs: DataFrame) -> DataFrame:
        wanted = reps.join(pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct(), "class")
        sets = written(_sets(docs, wanted, words))
        found = written(_confirmed(pairs, sets, percent))
        dropped(sets, pairs)
        return found

    links = confirm(tested)
    labels = components(nodes, links, size)
    # Buckets whose classes aren't all linked by now: their members are joined exactly, by rare shingles.
    known = members.select("key", "class").join(labels, "class")
    mixed = known.groupBy("key").agg(F.min("label").alias("_lo"), F.max("label").alias("_hi")).where(F.col("_lo") != F.col("_hi")).select("key")
    left = known.join(mixed, "key", "left_semi").select("class", "label").distinct()
    more = _by_rare_shingles(written(left), reps, lambda wanted: written(_sets(docs, wanted, words)), percent)
    if more.limit(1).count():
        both = written(links.union(more))
        labels = components(nodes, both, size + 2 * both.count())

    full = classes.select("class", "low", "rep").join(labels, "class", "left").withColumn("label", F.coalesce("label", "class"))
    # Written first, so that the join below has two plain sides, whose large groups Spark can split.
    lows = written(full.groupBy("label").agg(F.min("low").alias("component_id"), F.min("rep").alias("lead")))
    ids = full.join(lows, "label").select("class", "component_id", "lead")
    return rows.select("doc_id", "_th", "n_shingles", "class").join(ids, "class", "left")


def near_duplicates(docs: DataFrame, percent: int = MORE_THAN, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of ``docs`` (doc_id, text).

    Rows are linked if their sets of ``words``-word shingles share at least ``percent`` of their union;
    a component's id is the smallest doc_id in it. Null or blank texts have no shingles and are linked
    with nothing: their component is their own doc_id. Repeated rows are rows like any other. Null ids are
    passed over for the smallest, and a row with one is kept only if it has no words. Columns besides
    doc_id and text are left out.
    """
    alone = F.col("class").isNull()
    out = linked(docs, percent, words).withColumn("component_id", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), alone)
    return out.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def one_of_each(docs: DataFrame, percent: int = MORE_THAN, words: int = WORDS) -> DataFrame:
    """The rows of ``docs`` that stay if one document of each component does; rows without words all stay.

    The row with the smallest id stays, of equal ids the one with the smallest text hash, and of rows that
    are equal in both any one. Null ids come last. All columns stay, whatever their names. An empty table
    gives no rows.
    """
    rows, own = boxed(docs, ["doc_id", "text"])
    worded = F.regexp_like(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]"))
    leads = linked(docs, percent, words).where(F.col("class").isNotNull()).select(F.col("lead.doc_id").alias("_lead"), F.col("lead._th").alias("_lead_th")).distinct()
    some = rows.where(worded).withColumn("_th", F.xxhash64("text"))
    some = some.join(leads, F.col("doc_id").cast("bigint").eqNullSafe(F.col("_lead")) & (F.col("_th") == F.col("_lead_th")), "left_semi").dropDuplicates(["doc_id", "_th"])
    return some.select(own).unionByName(rows.where(~worded).select(own))
