"""Removal of repeated byte strings by bucket-pointer refinement over sampled suffixes.

A byte goes if some string of ``LENGTH`` bytes that covers it also starts elsewhere. Every such window
picks the position of its smallest ``GRAM``-byte hash as its anchor, so equal windows have anchors at
equal offsets, and only anchors (about one in 180 positions) are compared over documents:

1. Anchors are bucketed by their gram; anchors alone in a bucket are done.
2. Anchors whose whole surroundings (all windows that picked them) are equal form a class. A class with
   two occurrences is repeated throughout.
3. Other classes are refined within their bucket: positions start in q-gram buckets and are split by
   sorting on the bucket ids of the position itself and of the one a bucket's depth later, so that the
   depth doubles; ids of a round are used by the next, and positions alone in a bucket drop out. At depth
   ``LENGTH`` what shares a bucket is repeated.

Buckets with more than ``MOST`` classes are first split by longer grams: each half of an anchor's windows
is bucketed by what those windows have in common. That may end in single windows, whose buckets need no
comparison at all, so no bucket size is out of reach.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketloom.llm.common import together, written

LENGTH, GRAM, MOST, ROWS_AT_ONCE, BLOCK = 400, 40, 4000, 1500, 1 << 20
_BASE = 0x9E3779B97F4A7C15


def _byte_values() -> np.ndarray:
    return np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def gram_hashes(values: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` values from each position, by joining hashes of halves."""
    out, done, part, size, power = None, 0, values, 1, _BASE
    while True:
        if n & size:
            # ``out`` covers ``done`` values; ``part`` those after them.
            out = part if out is None else out[: len(values) - done - size + 1] * np.uint64(power) + part[done : len(values) - size + 1]
            done += size
        if done == n:
            return out ^ (out >> np.uint64(29))
        part = part[:-size] * np.uint64(power) + part[size:]
        size, power = 2 * size, power * power & 0xFFFFFFFFFFFFFFFF


def anchors(data: bytes, byte_values: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[int, int, int, int]]:
    """(anchor, first window, last window, gram hash) for each run of windows with one anchor: the leftmost smallest gram."""
    width = length - gram + 1
    for at in range(0, len(data) - length + 1, BLOCK):
        part = np.frombuffer(data, np.uint8, count=min(len(data) - at, BLOCK + length - 1), offset=at)
        h = gram_hashes(byte_values[part], gram) * np.uint64(0xBF58476D1CE4E5B9)
        low = (h & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(h), dtype=np.uint64)
        done, best = 1, low
        while done < width:
            step = min(done, width - done)
            best = np.minimum(best[:-step], best[step:])
            done += step
        where = (best & np.uint64(0xFFFFFF)).astype(np.int64)
        first = np.r_[0, np.flatnonzero(np.diff(where)) + 1]
        last = np.r_[first[1:] - 1, len(where) - 1]
        a = where[first]
        yield from zip((a + at).tolist(), (first + at).tolist(), (last + at).tolist(), h[a].view(np.int64).tolist(), strict=True)


def _occurrences(docs: DataFrame) -> DataFrame:
    """One row for each document and class of anchors in it: ref, doc_id, gram, class, lo and hi (least and most distance from a window's start to its anchor), positions."""
    schema = "doc_id bigint, ref binary, gram bigint, class binary, lo int, hi int, at array<int>"
    kinds = {"gram": pa.int64(), "class": pa.binary(), "lo": pa.int32(), "hi": pa.int32(), "at": pa.list_(pa.int32())}

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        values = _byte_values()
        for b in batches:
            row, out = [], []
            for i, text in enumerate(b.column("text")):
                data, seen = text.as_py().encode(), {}
                for a, first, last, gram in anchors(data, values):
                    cls = xxhash.xxh3_128_digest(b"%d,%d:" % (a - last, a - first) + data[first : last + LENGTH])
                    if cls in seen:
                        seen[cls][-1].append(a)
                    else:
                        seen[cls] = (gram, cls, a - last, a - first, [a])
                row += [i] * len(seen)
                out += seen.values()
            if out:
                # Ids stay in Arrow, so that they are exact also next to nulls.
                at = pa.array(row, pa.int64())
                found = [pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), kinds.values(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(at), b.column("ref").take(at), *found], ["doc_id", "ref", *kinds])

    return docs.where(F.octet_length("text") >= LENGTH).mapInArrow(find, schema)


def _contexts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """key, node_lo, node_hi (the distances that the key's bucket is about), class, lo, hi and the bytes of the class's windows, read at one occurrence."""
    schema = "key binary, node_lo int, node_hi int, class binary, lo int, hi int, bytes binary"
    asked = wanted.groupBy(F.col("rep.ref").alias("_ref"), F.col("rep.doc_id").alias("_doc")).agg(F.collect_list(F.struct("gram", "class", "lo", "hi", F.col("rep.a").alias("a"))).alias("_asked"))
    found = docs.join(asked, (F.col("ref") == F.col("_ref")) & F.col("doc_id").eqNullSafe(F.col("_doc"))).select("text", "_asked")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for text, asked in zip(b["text"], b["_asked"], strict=True):
                data = text.encode()
                out += [(int(x["gram"]).to_bytes(8, "little", signed=True), 0, LENGTH - GRAM, bytes(x["class"]), x["lo"], x["hi"], data[x["a"] - x["hi"] : x["a"] - x["lo"] + LENGTH]) for x in asked]
            yield pd.DataFrame(out, columns=["key", "node_lo", "node_hi", "class", "lo", "hi", "bytes"])

    return found.mapInPandas(cut, schema)


def _halved(rows: DataFrame) -> DataFrame:
    """Each row for either half of its bucket's distances that it has windows in, keyed by the bytes that all windows of the half share.

    Equal windows lie at equal distances from their anchors, and halves depend on the bucket alone, so
    equal windows stay together. The key of a single distance is the window.
    """

    def halve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for b in batches:
            out = []
            for x, y, cls, lo, hi, data in zip(b["node_lo"], b["node_hi"], b["class"], b["lo"], b["hi"], b["bytes"], strict=True):
                mid = (x + y) // 2
                for x2, y2 in {(x, mid), (mid + 1, y)}:
                    lo2, hi2 = max(lo, x2), min(hi, y2)
                    if lo2 <= hi2:
                        key = xxhash.xxh3_128_digest(b"%d:" % x2 + data[hi - x2 : hi - y2 + LENGTH])
                        out.append((key, x2, y2, cls, lo2, hi2, data[hi - hi2 : hi - lo2 + LENGTH]))
            yield pd.DataFrame(out, columns=["key", "node_lo", "node_hi", "class", "lo", "hi", "bytes"])

    return rows.mapInPandas(halve, rows.schema)


def repeated_starts(rows: list[bytes], groups: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Bucket-pointer refinement of the positions of ``rows`` laid end to end: true where the ``length`` bytes from there occur twice in the group."""
    sizes = np.array([len(r) for r in rows])
    ends = np.cumsum(sizes)
    flat = np.frombuffer(b"".join(rows), np.uint8)
    depth = length
    while depth % 2 == 0 and depth > 25:
        depth //= 2
    room = np.repeat(ends, sizes) - np.arange(len(flat))
    bucket = np.full(len(flat), -1, np.int64)
    alive = np.flatnonzero(room >= depth)
    key = gram_hashes(_byte_values()[flat], depth)[alive] * np.uint64(0xBF58476D1CE4E5B9) + np.repeat(groups, sizes).astype(np.uint64)[alive] * np.uint64(0x94D049BB133111EB)
    while True:
        _, ids, count = np.unique(key, return_inverse=True, return_counts=True)
        shared = count[ids] > 1
        bucket[alive] = np.where(shared, ids, -1)
        alive = alive[shared]
        if depth == length:
            out = np.zeros(len(flat), bool)
            out[alive] = True
            return out
        later = alive[room[alive] >= 2 * depth]
        later = later[bucket[later + depth] >= 0]
        key = bucket[later] * np.int64(len(flat) + 1) + bucket[later + depth]
        bucket[alive[~np.isin(alive, later, assume_unique=True)]] = -1
        alive, depth = later, 2 * depth


def _refined(rows: DataFrame) -> DataFrame:
    """class, from and to (relative to the anchor) of the repeated windows of each class; buckets are read as a stream, in order."""
    schema = "class binary, from int, to int"
    ordered = together(rows, "key").sortWithinPartitions("key", "class")

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates(["key", "class", "lo", "hi"])
        data = list(rows["bytes"])
        hit = repeated_starts(data, pd.factorize(rows["key"])[0])
        edge = np.flatnonzero(np.diff(np.r_[False, hit, False].astype(np.int8)))
        first, last = edge[::2], edge[1::2] - 1
        starts = np.cumsum([0, *map(len, data)])
        row = np.searchsorted(starts, first, "right") - 1
        base = starts[row] + rows["hi"].to_numpy()[row]
        return pd.DataFrame({"class": rows["class"].to_numpy()[row], "from": first - base, "to": last - base + LENGTH})

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for b in batches:
            for k in range(0, len(b), ROWS_AT_ONCE):
                held.append(b.iloc[k : k + ROWS_AT_ONCE])
                now = pd.concat(held) if len(held) > 1 else held[0]
                whole = (now["key"] != now["key"].iloc[-1]).to_numpy()
                if whole.any():
                    yield solve(now[whole])
                held = [now[~whole]]
        if held and len(held[0]):
            yield solve(pd.concat(held))

    return ordered.mapInPandas(stream, schema)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes) and text (its whole characters) for each row of ``docs``.

    A null text is empty; texts of fewer than ``LENGTH`` bytes lose nothing. Equal texts, also of equal
    or null ids, are occurrences of each other and go whole. A character that loses some of its bytes
    isn't in ``text``. An empty table gives no rows. Columns besides doc_id and text are left out, so
    their names don't matter.
    """
    docs = docs.select(F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit("")).alias("text")).withColumn("ref", F.unhex(F.md5("text")))
    found = written(_occurrences(docs))
    shared = found.groupBy("gram").agg(F.sum(F.size("at")).alias("n")).where("n > 1").select("gram")
    found = written(found.join(shared, "gram", "left_semi"), found)
    classes = found.groupBy("class").agg(F.min("gram").alias("gram"), F.min("lo").alias("lo"), F.min("hi").alias("hi"), F.sum(F.size("at")).alias("n"), F.min(F.struct("ref", "doc_id", F.col("at")[0].alias("a"))).alias("rep"))
    classes = written(classes)
    unsure = classes.groupBy("gram").agg(F.count(F.lit(1)).alias("_classes"), F.min("n").alias("_least")).where("_classes > 1 AND _least = 1").select("gram")
    rows = written(_contexts(docs, classes.join(unsure, "gram", "left_semi")))
    spans = classes.where("n > 1").select("class", (-F.col("hi")).alias("from"), (LENGTH - F.col("lo")).alias("to"))
    while (big := rows.groupBy("key").count().where(F.col("count") > MOST).select("key")).limit(1).count():
        spans = spans.union(_refined(rows.join(big, "key", "left_anti")))
        halves = written(_halved(rows.join(big, "key", "left_semi").select(rows.columns)))
        pairs = halves.groupBy("key").agg(F.countDistinct("class").alias("_n")).where("_n > 1").select("key")
        halves = written(halves.join(pairs, "key", "left_semi").select(rows.columns), halves)
        # A single window that shares its key is repeated, whatever the size of its bucket.
        spans = spans.union(halves.where("node_lo = node_hi").select("class", (-F.col("hi")).alias("from"), (LENGTH - F.col("lo")).alias("to")))
        rows = halves.where("node_lo < node_hi")
    spans = written(spans.union(_refined(rows)))
    covered = found.select("ref", "doc_id", "class", F.explode("at").alias("a")).join(spans, "class").groupBy(F.col("ref").alias("_ref"), F.col("doc_id").alias("_doc"))
    covered = covered.agg(F.sort_array(F.collect_set(F.struct((F.col("a") + F.col("from")).alias("start"), (F.col("a") + F.col("to")).alias("end")))).alias("_spans"))
    joined = docs.join(covered, (F.col("ref") == F.col("_ref")) & F.col("doc_id").eqNullSafe(F.col("_doc")), "left")
    starts, ends = F.transform("_spans", lambda s: s.start), F.transform("_spans", lambda s: s.end)

    @F.pandas_udf("n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary, text string")
    def cut(texts: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.DataFrame:
        out = []
        for text, first, last in zip(texts, starts, ends, strict=True):
            data, kept, end, n = text.encode(), [], 0, 0
            for a, b in zip(first, last, strict=True) if first is not None else ():
                if a > end or not n:
                    kept.append(data[end:a])
                    n += 1
                end = max(end, b)
            kept.append(data[end:])
            left = b"".join(kept)
            out.append((len(data), len(data) - len(left), n, hashlib.sha256(left).hexdigest(), left, "".join(k.decode(errors="ignore") for k in kept)))
        return pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "text"])

    return joined.select("doc_id", cut("text", starts, ends).alias("_r")).select("doc_id", "_r.*")
