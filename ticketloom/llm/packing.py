"""Best-fit packing: tokens of documents in as few fixed-length sequences as possible.

Documents are tokenized in Arrow batches; the histogram of piece lengths (at most ``SEQUENCE`` rows) is
all that the driver plans with. Patterns of up to three lengths that fill a sequence are enumerated on a
grid, non-negative least squares fits how often each pattern is repeated to the histogram, counts are
rounded down, and what is left is packed best-fit into the gaps and into new sequences, still by length
and count. The plan comes out as runs: "pieces of length L with ranks from R lie in sequences from S at
offset O". Ranks within a length are given in Spark, salted, so that no length meets in one task.
"""

from __future__ import annotations

import bisect
import re
import struct
import sys
import types
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketloom.llm.common import boxed, settings, written

SEQUENCE, END_ID, GRID, SALTS = 4096, 1, 32, 64
#: Chunks of text whose ids a Python worker remembers, and how many there may be for forms of words to be among them: forms
#: (capitals, punctuation after it) are made up of a word's ids, so the rest is left to words and to what isn't one. None is longer
#: than ``CHUNK`` characters.
CACHE, FORMS, CHUNK = 300_000, 120_000, 64
#: Rows that a Python worker gets at once while documents are tokenized, and the most bytes of them.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}
#: A word of letters that normalization only lower-cases, and the punctuation after it.
SIMPLE = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?*%$&#|]*)")


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenized(docs: DataFrame, vocabulary: str | None = None, sequence: int = SEQUENCE, keep_ids: bool = False) -> DataFrame:
    """One row for each piece: the columns of ``docs`` but ``text``, then piece, start, length, ids_crc32[, ids].

    A document's ids are its text's ids and ``END_ID``; a null text is empty, so it has that id alone. Only
    documents longer than ``sequence`` are cut. The vocabulary drops white space and never joins over it,
    so chunks between blanks are encoded on their own and the ids of ``CACHE`` of them remembered while the
    worker lives; those of others are worked out each time.
    """
    made = ["piece", "start", "length", "ids_crc32", "ids"]
    kept = docs.drop(*made)
    fields = [f for f in kept.schema.fields if f.name != "text"]
    more = {"piece": (T.IntegerType(), pa.int32()), "start": (T.LongType(), pa.int64()), "length": (T.LongType(), pa.int64()), "ids_crc32": (T.LongType(), pa.int64())}
    if keep_ids:
        more["ids"] = (T.ArrayType(T.IntegerType()), pa.list_(pa.int32()))
    path, end = vocabulary, np.uint32(END_ID).astype("<u4").tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        encoder = Tokenizer.from_file(path or vocabulary_path())
        model = encoder.model
        worker = sys.modules.setdefault("ticketloom_worker", types.SimpleNamespace(ids={}))
        known: dict[str, bytes] = worker.ids.setdefault(path, {"": b""})
        # The byte-level alphabet: printable bytes stand for themselves, others for the characters from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letter = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(sorted({*range(256)} - {*plain}))}
        spelled = {c: "".join(letter[x] for x in chr(c).encode()) for c in range(0xC0, 0x100)}

        def ids_at(chunk: str) -> bytes:
            got = known.get(chunk)
            if got is None:
                most, m = CACHE, SIMPLE.fullmatch(chunk)
                if m is None:
                    ids = encoder.encode(chunk, add_special_tokens=False).ids
                    got = struct.pack(f"<{len(ids)}I", *ids)
                elif (word := m[1].lower()) != chunk:
                    got, most = ids_at(word) + (ids_at(m[2]) if m[2] else b""), FORMS
                else:
                    ids = [t.id for t in model.tokenize(word.translate(spelled))]
                    got = struct.pack(f"<{len(ids)}I", *ids)
                if len(known) < most and len(chunk) <= CHUNK:
                    known[chunk] = got
            return got

        def ids_of(text: str | None) -> bytes:
            chunks = (text or "").replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
            try:
                return b"".join([known[c] for c in chunks])
            except KeyError:
                return b"".join([ids_at(c) for c in chunks])

        def cut(b: pa.RecordBatch) -> pa.RecordBatch:
            at, out = [], []
            for i, text in enumerate(b.column("text")):
                ids = ids_of(text.as_py()) + end
                for k in range(0, len(ids), 4 * sequence):
                    part = ids[k : k + 4 * sequence]
                    at.append(i)
                    out.append((k // 4 // sequence, k // 4, len(part) // 4, zlib.crc32(part), *([np.frombuffer(part, "<u4").astype(np.int32)] if keep_ids else [])))
            # The caller's columns stay in Arrow, so that ids are exact also next to nulls.
            rows = b.drop_columns(["text"]).take(pa.array(at, pa.int64()))
            values = zip(*out, strict=True) if out else [[] for _ in more]
            found = [pa.array(list(v), kind) for v, (_, kind) in zip(values, more.values(), strict=True)]
            return pa.RecordBatch.from_arrays([*rows.columns, *found], [*rows.schema.names, *more])

        yield from map(cut, batches)  # a loop's variable would hold a batch until the next one is read

    return kept.mapInArrow(pieces, T.StructType([*fields, *[T.StructField(n, kind) for n, (kind, _) in more.items()]]))


def nnls(a: np.ndarray, b: np.ndarray, most: int = 400) -> np.ndarray:
    """min |a x - b| over x >= 0, by the active-set method of Lawson and Hanson."""
    ata, atb = a.T @ a, a.T @ b
    x, used = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    for _ in range(most):
        gain = np.where(used, -np.inf, atb - ata @ x)
        j = int(gain.argmax())
        if gain[j] <= 1e-7 * max(1.0, np.abs(atb).max()):
            break
        used[j] = True
        while True:
            s, k = np.zeros_like(x), np.flatnonzero(used)
            s[k] = np.linalg.lstsq(ata[np.ix_(k, k)], atb[k], rcond=None)[0]
            if (s[k] > 0).all():
                x = s
                break
            low = k[s[k] <= 0]
            step = np.min(x[low] / np.maximum(x[low] - s[low], 1e-300))
            x = x + step * (s - x)
            used &= x > 1e-12
            x[~used] = 0
    return x


def _patterns(bins: list[int], full: int) -> list[tuple[int, ...]]:
    """Multisets of up to three of the bins that add up to ``full``."""
    have = set(bins)
    out = [(full,)] if full in have else []
    for a in bins:
        if full - a in have and a <= full - a:
            out.append((a, full - a))
        out += [(a, b, full - a - b) for b in bins if a <= b <= full - a - b and full - a - b in have]
    return out


def plan(histogram: dict[int, int], sequence: int = SEQUENCE, fill_below: int = 256, grid: int = GRID) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, count, first sequence, offset) that place every piece of the histogram.

    Pieces shorter than ``fill_below`` are left out of the patterns and fill gaps.
    """
    left = {k: v for k, v in histogram.items() if v}
    # Groups of equal sequences: [count, lengths, gap].
    groups: list[tuple[int, tuple[int, ...]]] = []
    by_bin: dict[int, list[int]] = defaultdict(list)
    for k in sorted(left, reverse=True):
        if k >= fill_below:
            by_bin[-(-k // grid)].append(k)
    bins, full = sorted(by_bin), -(-sequence // grid)
    patterns = _patterns(bins, full)
    if patterns:
        row = {g: i for i, g in enumerate(bins)}
        a = np.zeros((len(bins), len(patterns)))
        for j, p in enumerate(patterns):
            for g in p:
                a[row[g], j] += 1
        need = np.array([sum(left[k] for k in by_bin[g]) for g in bins], float)
        # Long documents are hardest to place later, so their rows weigh more.
        weight = np.array(bins, float)[:, None] / full
        repeats = np.floor(nnls(a * weight, need * weight[:, 0]) + 1e-9).astype(int)
        for j in sorted(np.flatnonzero(repeats), key=lambda j: -max(patterns[j])):
            times = int(repeats[j])
            while times > 0:
                lengths: list[int] = []
                for g in sorted(patterns[j], reverse=True):
                    ok = [k for k in by_bin[g] if left.get(k, 0) > lengths.count(k) and sum(lengths) + k <= sequence]
                    if not ok:
                        break
                    lengths.append(ok[0])
                if len(lengths) < len(patterns[j]):
                    break
                n = min(times, *(left[k] // lengths.count(k) for k in lengths))
                groups.append((n, tuple(lengths)))
                times -= n
                for k in lengths:
                    left[k] -= n
    gaps: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)
    order: list[int] = []  # gaps that some group has

    def put(n: int, lengths: tuple[int, ...]) -> None:
        gap = sequence - sum(lengths)
        if not gaps[gap]:
            bisect.insort(order, gap)
        gaps[gap].append((n, lengths))

    for n, lengths in groups:
        put(n, lengths)
    for k in sorted(left, reverse=True):
        while left[k] > 0:
            i = bisect.bisect_left(order, k)
            if i == len(order):
                per = sequence // k  # new sequences, as full of this length as they get
                n = left[k] // per
                if n:
                    put(n, (k,) * per)
                    left[k] -= n * per
                if left[k]:
                    put(1, (k,) * left[k])
                    left[k] = 0
                continue
            gap = order[i]
            n, lengths = gaps[gap].pop()
            if not gaps[gap]:
                order.pop(i)
            per = min(gap // k, left[k])
            take = min(n, left[k] // per)
            if take < n:
                put(n - take, lengths)
            put(take, lengths + (k,) * per)
            left[k] -= take * per
    runs, ranks, first = [], defaultdict(int), 0
    for gap in sorted(gaps):
        for n, lengths in gaps[gap]:
            at = 0
            for k in lengths:
                runs.append((k, ranks[k], n, first, at))
                ranks[k] += n
                at += k
            first += n
    return runs


def best_plan(histogram: dict[int, int], sequence: int = SEQUENCE) -> list[tuple[int, int, int, int, int]]:
    """The plan with the fewest sequences over several bounds between patterns and filling."""
    plans = [plan(histogram, sequence, below) for below in (64, 256, 512, 1024)]
    return min(plans, key=lambda runs: max((r[3] + r[2] for r in runs), default=0))


def pack(pieces: DataFrame, sequence: int = SEQUENCE) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, length, ids_crc32, ...), which must be a written table.

    Pieces that are equal in doc_id, piece and ids are interchangeable, so ranks are the same for any order
    of them. Other columns stay, whatever their names, but those named like an added one are replaced. An
    empty table gives no rows.
    """
    df, own = boxed(pieces, ["doc_id", "piece", "length", "ids_crc32"], ("sequence_id", "offset"))
    df = df.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(SALTS)))
    counts = df.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    histogram: dict[int, int] = defaultdict(int)
    first, rows = [], sorted(counts.collect(), key=lambda r: (r["length"], r["_salt"]))  # sequence * SALTS rows at most
    for r in rows:
        first.append((r["length"], r["_salt"], histogram[r["length"]]))
        histogram[r["length"]] += r["_n"]
    runs = sorted(best_plan(histogram, sequence))
    key = np.array([r[0] for r in runs], np.int64) * (1 << 44) + np.array([r[1] for r in runs], np.int64)
    plan_of = pieces.sparkSession.sparkContext.broadcast((key, *(np.array([r[k] for r in runs], np.int64) for k in (1, 3, 4)), {(k, s): n for k, s, n in first}))
    order = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def place(length: pd.Series, salt: pd.Series, rank: pd.Series) -> pd.DataFrame:
        key, first, seq, offset, base = plan_of.value
        r = rank.to_numpy(np.int64) - 1 + np.array([base[k] for k in zip(length, salt, strict=True)], np.int64)
        at = np.searchsorted(key, length.to_numpy(np.int64) * (1 << 44) + r, "right") - 1
        return pd.DataFrame({"sequence_id": seq[at] + r - first[at], "offset": offset[at]})

    placed = df.withColumn("_rank", F.row_number().over(order)).withColumn("_place", place("length", "_salt", "_rank"))
    return placed.select(*own, "_place.sequence_id", "_place.offset")


def pack_documents(docs: DataFrame, vocabulary: str | None = None, sequence: int = SEQUENCE, keep_ids: bool = False) -> DataFrame:
    """Tokenizes and packs ``docs``: a row for each piece with its sequence and place there.

    Null and empty texts are pieces of one token; repeated rows are packed each; an empty table gives no
    rows. Other columns of ``docs`` stay, but those named like an added one are replaced.
    """
    with settings(docs.sparkSession, BATCH):
        pieces = written(tokenized(docs, vocabulary, sequence, keep_ids))
    return pack(pieces, sequence)
