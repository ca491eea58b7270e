"""Name detection: chunks, a pluggable detector, and decoding of token labels into spans."""

from __future__ import annotations

import itertools
import re
import sys
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketloom.functions.scalars import _bound
from ticketloom.scratch import dealt, written

CHUNK, MIN_CONFIDENCE = 1200, 0.7
#: Tokens that a chunk may have, and characters of the next chunk that a detector sees with it.
MOST_TOKENS, OVERLAP = 512, 200
#: Texts that a task cuts at a time.
TOGETHER = 64
BLOCK = 512
#: Parts of a set of names, and bits of each.
PARTS, BITS = 1024, 16384
#: Most names of a detector that holds them in memory; any number can be found by ``names_in_texts``.
MOST_NAMES = 200_000
#: Characters of a text that are cut into words together.
PIECE = 4096
WORD = r"[\p{L}\p{N}]+(?:['’-][\p{L}\p{N}]+)*"
#: The same words, and what stands between two, by repeats that never go back: texts and words of any length.
_JOINED = r"(?:['’-][\p{L}\p{N}]++)*+"
_ONE_WORD = r"[\p{L}\p{N}]++" + _JOINED
_GAP = r"[^\p{L}\p{N}]*+"
#: Gaps of nothing but blanks, with an ``x`` between any two.
_BLANKS = r"^(?:\s++[\u0085\u2028\u2029]?+(?:x|\z))*+\z"
_TOKEN = re.compile(r"\w+|[^\w\s]")
LABELS = ("O", "B-PER", "I-PER", "B-LOC", "I-LOC", "B-ORG", "I-ORG")
# Where a chunk may end if it has neither newline nor blank.
_SPECIAL = "<>{}()[];:,./\\|!@#$%^&*=+?\"'`~"


def _fits(text: str, most: int, most_tokens: int | None) -> int:
    """How much of a text's start is at most ``most`` characters and, if given, ``most_tokens`` tokens (words and single marks)."""
    if most_tokens is None or len(text) <= min(most, most_tokens):
        return min(most, len(text))
    after = next(itertools.islice(_TOKEN.finditer(text, 0, most), most_tokens, None), None)
    return after.start() if after else min(most, len(text))


def cuts(text: str, most: int = CHUNK, most_tokens: int | None = None) -> list[tuple[int, str]]:
    """(offset, chunk) pairs that join to the text, cut after the last newline, else blank, else special character of what fits.

    A chunk has at most ``most`` characters and, if given, ``most_tokens`` tokens, so that nothing is lost to a model's limit.
    """
    out, at = [], 0
    while (fits := _fits(text[at : at + most + 1], most, most_tokens)) < len(text) - at:
        window = text[at : at + fits]
        end = next((i + 1 for i in (window.rfind("\n"), max(window.rfind(" "), window.rfind("\t")), max(window.rfind(c) for c in _SPECIAL)) if i > 0), fits)
        out.append((at, window[:end]))
        at += end
    return [*out, (at, text[at:])]


def chunk_text(df: DataFrame, most: int = CHUNK, most_tokens: int | None = None, overlap: int = 0) -> DataFrame:
    """A row (doc_id, chunk_id, text, offset) for each chunk; cut points depend on each other, so this is a Python stream.

    With ``overlap`` there is also ``seen``: the chunk and so many characters that follow it.
    """
    fields = [df.schema["doc_id"], *T.StructType.fromDDL("chunk_id int, text string, offset int" + (", seen string" if overlap else "")).fields]

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            # A few texts at a time, so that memory holds their chunks alone.
            for first in range(0, whole.num_rows, TOGETHER):
                batch, rows = whole.slice(first, TOGETHER), []
                for i, t in enumerate(batch.column("text").to_pylist()):
                    rows += [(i, k, x, at, (t or "")[at : at + len(x) + overlap]) for k, (at, x) in enumerate(cuts(t or "", most, most_tokens))]
                row, nth, text, at, seen = zip(*rows, strict=True)
                # Ids are taken as they are, so they are exact also next to nulls.
                out = {"doc_id": batch.column("doc_id").take(pa.array(row)), "chunk_id": pa.array(nth, pa.int32()), "text": pa.array(text), "offset": pa.array(at, pa.int32())}
                yield pa.RecordBatch.from_pydict(out | ({"seen": pa.array(seen)} if overlap else {}))

    return dealt(df.select("doc_id", "text")).mapInArrow(chunks, T.StructType(fields))


Detector = Callable[[list[str]], list[list[tuple[int, int, float]]]]


def without_overlap(spans: Column) -> Column:
    """Of spans (array of structs that begin with start and end) those that leave no character to two of them: from the left, the longest first."""
    item = lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("least"), s.alias("span"))
    ordered = F.transform(F.sort_array(F.transform(spans, item)), lambda x: x["span"])
    # Whether one is kept is decided by where the last kept one ends.
    zero = F.struct(F.lit(-1).cast("bigint").alias("at"), F.slice(spans, F.lit(1), F.lit(0)).alias("out"))
    keep = lambda a, s: F.when(s["start"] >= a["at"], F.struct(s["end"].cast("bigint").alias("at"), F.array_append(a["out"], s).alias("out"))).otherwise(a)
    return F.aggregate(ordered, zero, keep, lambda a: a["out"])


def detect_names(df: DataFrame, make_detector: Callable[[], Detector], failures: Accumulator | None = None, most: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, start, end, text, score) from a detector that is made once for each task.

    A detector takes chunk texts and returns (start, end, score) spans for each. It sees each chunk with the
    ``overlap`` characters that follow, so that a name over an edge is whole in the chunk that it starts in;
    what the next chunk finds of its rest is left out with the other spans that overlap one further left.
    A chunk that it fails on has none; ``failures`` counts such chunks and each task's first error goes to its
    log, so that a broken detector doesn't pass for a text without names.
    """
    @F.pandas_udf("starts array<int>, ends array<int>, scores array<double>")
    def spans(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        detect, failed = make_detector(), 0
        for texts in batches:
            found = []
            for text in texts:
                try:
                    found.append(detect([text])[0])
                except Exception as error:  # noqa: BLE001 - a detector is foreign code
                    found.append([])
                    failed += 1
                    if failed == 1:
                        print(f"name detector failed: {error!r}", file=sys.stderr)
                    if failures is not None:
                        failures.add(1)
            yield pd.DataFrame({"starts": [[s for s, _, _ in f] for f in found], "ends": [[e for _, e, _ in f] for f in found], "scores": [[float(x) for _, _, x in f] for f in found]})

    # A document is known by its id and text; rows that are there twice would only give their names twice.
    rows = df.select("doc_id", "text").withColumn("doc_id", F.struct("doc_id", F.xxhash64("text").alias("th")))
    said = chunk_text(rows, most, MOST_TOKENS, max(1, overlap)).withColumn("_f", spans("seen"))
    said = said.select("doc_id", "text", "seen", "offset", F.explode(F.arrays_zip(F.col("_f.starts").alias("s"), F.col("_f.ends").alias("e"), F.col("_f.scores").alias("score"))).alias("_f"))
    name = F.substring(F.col("seen"), F.col("_f.s") + 1, F.col("_f.e") - F.col("_f.s"))
    own = said.where(F.col("_f.s") < F.length("text")).select("doc_id", F.struct((F.col("offset") + F.col("_f.s")).alias("start"), (F.col("offset") + F.col("_f.e")).alias("end"), name.alias("text"), F.col("_f.score").alias("score")).alias("span"))
    kept = own.groupBy("doc_id").agg(F.collect_set("span").alias("spans")).select(F.col("doc_id.doc_id").alias("doc_id"), F.explode(without_overlap(F.col("spans"))).alias("s"))
    return kept.select("doc_id", "s.start", "s.end", "s.text", "s.score")


class NameTrie:
    """A detector over a table of names in memory: a trie of their words, from which the longest name at each place is read off.

    The trie is one dictionary: from the words up to a node, joined by blanks, to whether a name ends there.
    Words of a name have nothing but blanks between them; letters' case counts. The spans score 1.
    """

    def __init__(self, names: list[str]) -> None:
        self.ends: dict[str, bool] = {}
        for name in names:
            words = _WORD.findall(name)
            for n in range(1, len(words) + 1):
                node = " ".join(words[:n])
                self.ends[node] = self.ends.get(node, False) or n == len(words)

    def __call__(self, texts: list[str]) -> list[list[tuple[int, int, float]]]:
        return [self.find(t) for t in texts]

    def find(self, text: str) -> list[tuple[int, int, float]]:
        words = [(m[0], m.start(), m.end()) for m in _WORD.finditer(text)]
        out, i = [], 0
        while i < len(words):
            node, last = words[i][0], None
            for j in range(i, len(words)):
                if j > i:
                    if text[words[j - 1][2] : words[j][1]].strip():
                        break
                    node = f"{node} {words[j][0]}"
                ends = self.ends.get(node)
                if ends is None:
                    break
                if ends:
                    last = j
            if last is None:
                i += 1
            else:
                out.append((words[i][1], words[last][2], 1.0))
                i = last + 1
        return out


#: ``WORD`` for Python: letters and digits are what str.isalnum tells apart from ``_``.
_WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")


def trie_detector(names: DataFrame, most: int = MOST_NAMES) -> Callable[[], Detector]:
    """What ``detect_names`` makes its detector of: the names of a table (column ``name``), at most ``most``; more are an error."""
    found = [r.name for r in names.select("name").where("name IS NOT NULL").distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"more than {most} names: use names_in_texts")
    return lambda: NameTrie(found)


def words_of(text: Column) -> Column:
    """array<struct<word, start, end, glued>>: words with their places; ``glued`` where nothing but blanks stands between it and the word before.

    Places are sums of lengths, taken in blocks of ``BLOCK`` words and over the blocks, so that a long text
    isn't copied once for each of its words.
    """
    kind = "array<struct<word:string,start:int,end:int,glued:boolean>>"
    size = lambda x: F.length(x["gap"]) + F.length(x["word"])

    def step(a: Column, x: Column) -> Column:
        start = a["at"] + F.length(x["gap"])
        end = start + F.length(x["word"])
        here = F.struct(x["word"].alias("word"), start.alias("start"), end.alias("end"), F.regexp_like(x["gap"], F.lit(r"^\s+$")).alias("glued"))
        return F.struct(end.alias("at"), F.array_append(a["out"], here).alias("out"))

    def placed(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, x: a + size(x)))
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        starts = F.aggregate(sums, zero, lambda a, n: F.struct((a["at"] + n).alias("at"), F.array_append(a["out"], a["at"]).alias("out")), lambda a: a["out"])
        inside = lambda b, at: F.aggregate(b, F.struct(at.alias("at"), F.array().cast(kind).alias("out")), step, lambda a: a["out"])
        return F.flatten(F.zip_with(blocks, starts, inside))

    # Gaps run one past the words; the last pair has a null word and goes.
    pairs = F.zip_with(F.split(text, WORD, -1), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda g, w: F.struct(g.alias("gap"), w.alias("word")))
    cut = lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / BLOCK).cast("int")), lambda k: F.filter(F.slice(p, k * BLOCK + 1, F.lit(BLOCK)), lambda x: x["word"].isNotNull()))
    return _bound(_bound(pairs, cut), placed)


def _pieces(text: Column, ahead: int) -> Column:
    """array<struct<piece, at, rest>>: a text of any length cut where words begin, each after ``PIECE`` characters, the word that these end in, and its gap.

    ``at`` is where a piece starts, ``rest`` the next ``ahead`` words with their gaps. No word goes over an edge, so
    those of a piece are found without the others.
    """
    cut = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{PIECE}}}+[\p{{L}}\p{{N}}]*+{_JOINED}{_GAP}"), F.lit(0))
    heads = lambda p: F.transform(p, lambda x: F.regexp_extract(x, rf"^(?:{_ONE_WORD}{_GAP}){{0,{ahead}}}+", 0))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    starts = lambda p: F.aggregate(p, zero, lambda a, x: F.struct((a["at"] + F.length(x)).alias("at"), F.array_append(a["out"], a["at"]).alias("out")), lambda a: a["out"])
    # A piece can have fewer words than are asked for; it is then in its head as a whole, and the next one's head goes on.
    rest = lambda h, k: F.array_join(F.slice(h, k + 2, F.lit(ahead)), "")
    item = lambda h, s: lambda x, k: F.struct(x.alias("piece"), F.get(s, k).alias("at"), rest(h, k).alias("rest"))
    placed = lambda p: _bound(heads(p), lambda h: _bound(starts(p), lambda s: F.transform(p, item(h, s))))
    return _bound(F.when(F.length(text) <= PIECE, F.array(text)).otherwise(cut), placed)


def _bitmap(hashes: DataFrame) -> DataFrame:
    """(_part, _map): a stored bitmap of the ``hash`` column in ``PARTS`` parts of ``BITS`` bits, two megabytes whatever the rows."""
    part, bit = _place(F.col("hash"))
    set_ = hashes.select(part.alias("_part"), F.shiftright(bit, 6).alias("_long"), F.pmod(bit, F.lit(64)).alias("_at")).distinct()
    longs = set_.groupBy("_part", "_long").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("_at"))).alias("_bits"))
    # The longs of a part stand in order, with zeros where no bit is set.
    every = longs.select("_part").distinct().select("_part", F.explode(F.sequence(F.lit(0), F.lit(BITS // 64 - 1))).alias("_long"))
    full = every.join(longs, ["_part", "_long"], "left").groupBy("_part").agg(F.array_sort(F.collect_list(F.struct("_long", F.coalesce("_bits", F.lit(0).cast("bigint")).alias("_bits")))).alias("_map"))
    return written(full.select("_part", F.transform("_map", lambda x: x["_bits"]).alias("_map")))


def _place(hash_: Column) -> tuple[Column, Column]:
    return F.pmod(hash_, F.lit(PARTS)), F.pmod(F.shiftright(hash_, 10), F.lit(BITS)).cast("int")


def _likely(tried: DataFrame, column: str, bitmap: DataFrame) -> DataFrame:
    """The rows whose ``column``'s hash may be in a bitmap.

    The bitmap is sent to the rows, so nothing is dealt out; what it lets through by chance finds no partner later.
    """
    part, bit = _place(F.col("_hash"))
    some = tried.withColumn("_hash", F.xxhash64(column)).join(F.broadcast(bitmap), part == F.col("_part"))
    return some.where(F.getbit(F.get("_map", F.shiftright(bit, 6)), F.pmod(bit, F.lit(64))) == 1).select(*tried.columns)


def names_in_texts(texts: DataFrame, names: DataFrame, key: tuple[str, ...] = ("doc_id",), column: str = "text") -> DataFrame:
    """(*key, start, end, text): where names of a table (column ``name``) stand in texts, from the left, the longest first. Any number of names.

    ``key`` tells texts apart; texts with equal keys count as one. A bitmap of the names' first words and of their
    lists of words goes to the task that reads the text: from each word that it lets through, as many words as any
    name has are tried, and only lists that it lets through too are shuffled, and joined to those of the names,
    which is exact. No Python; texts are dealt out once. Null and empty texts and names have none.
    """
    found_in = lambda x: F.regexp_extract_all(x, F.lit(_ONE_WORD), F.lit(0))
    lists = written(names.where("name IS NOT NULL").select(found_in(F.col("name")).alias("words")).where(F.size("words") > 0).distinct())
    sizes = sorted(r.n for r in lists.select(F.size("words").alias("n")).distinct().collect()) or [1]
    said = dealt(texts.where(F.col(column).isNotNull()).select(*key, column)).select(*key, F.explode(_pieces(F.col(column), sizes[-1] - 1)).alias("_p"))
    seen = F.concat("_p.piece", "_p.rest")
    said = said.select(*key, F.col("_p.at").alias("_at"), found_in(seen).alias("_w"), F.split(seen, _ONE_WORD, -1).alias("_g"), F.size(found_in(F.col("_p.rest"))).alias("_more"))
    bitmap = _bitmap(lists.select(F.explode(F.array(F.xxhash64(F.col("words")[0]), F.xxhash64("words"))).alias("hash")))
    # From here to the last filter all is one compiled stage: nothing is interpreted for a word, and a piece's lists aren't copied for it.
    first = said.select("*", F.posexplode(F.slice("_w", F.lit(1), F.size("_w") - F.col("_more"))).alias("_i", "_first"))
    first = _likely(first, "_first", bitmap).select("*", F.explode(F.array(*map(F.lit, sizes))).alias("_n"))
    i, n, length = F.col("_i"), F.col("_n"), lambda x: F.length(F.array_join(x, ""))
    gaps = F.slice("_g", i + 2, n - 1)
    tried = first.where((i + n <= F.size("_w")) & F.regexp_like(F.array_join(gaps, "x"), F.lit(_BLANKS)))
    tried = _likely(tried.withColumn("words", F.slice("_w", i + 1, n)), "words", bitmap)
    start = F.col("_at") + length(F.slice("_g", F.lit(1), i + 1)) + length(F.slice("_w", F.lit(1), i))
    tried = tried.select(*key, "words", start.alias("start"), (length("words") + length(gaps)).alias("_size"))
    found = tried.join(lists, "words", "left_semi").select(*key, F.struct("start", (F.col("start") + F.col("_size")).alias("end"), F.array_join("words", " ").alias("text")).alias("span"))
    kept = found.groupBy(*key).agg(F.collect_set("span").alias("spans")).select(*key, F.explode(without_overlap(F.col("spans"))).alias("_s"))
    return kept.select(*key, "_s.start", "_s.end", "_s.text")


def gazetteer_names(df: DataFrame, names: DataFrame | list[str]) -> DataFrame:
    """(doc_id, text) of the distinct gazetteer names that stand in the texts, without Python."""
    if isinstance(names, list):
        names = df.sparkSession.createDataFrame([(n,) for n in names], "name string")
    return names_in_texts(df, names).select("doc_id", "text").distinct()


def label_map(labels: dict[int, str]) -> list[str]:
    """Labels by id, which have to be 0 to n - 1."""
    if sorted(labels) != list(range(len(labels))):
        raise ValueError("label ids must run from 0 without a gap")
    return [labels[i] for i in range(len(labels))]


def decode_logits(scores: Column | str, labels: tuple[str, ...] | list[str] = LABELS) -> Column:
    """struct(label, confidence): the label of the first highest score, and its share under softmax; ``O`` for no scores or none of the labels."""
    s = F.col(scores) if isinstance(scores, str) else scores
    best = F.array_position(s, F.array_max(s)).cast("int")
    share = 1 / F.aggregate(s, F.lit(0.0), lambda a, x: a + F.exp(x.cast("double") - F.array_max(s).cast("double")))
    label = F.coalesce(F.get(F.array(*map(F.lit, labels)), best - 1), F.lit("O"))
    return F.when(F.coalesce(F.size(s), F.lit(0)) > 0, F.struct(label.alias("label"), share.alias("confidence"))).otherwise(F.struct(F.lit("O").alias("label"), F.lit(0.0).alias("confidence")))


def merge_person_spans(tokens: DataFrame, texts: DataFrame | None = None, least: float = MIN_CONFIDENCE) -> DataFrame:
    """(doc_id, chunk_id, start, end, score) of the persons that label runs spell.

    ``tokens``: doc_id, chunk_id, tok_idx, label, conf, start, end. A run starts at B-PER and goes on with
    I-PER; special tokens (0, 0) and all else end it. With ``texts`` (doc_id, chunk_id, text) the span's
    trimmed text is added, and spans without any are left out.
    """
    special = (F.col("start") == 0) & (F.col("end") == 0)
    breaks = F.when(special | (F.col("label") != "I-PER"), 1).otherwise(0)
    order = Window.partitionBy("doc_id", "chunk_id").orderBy("tok_idx").rowsBetween(Window.unboundedPreceding, 0)
    runs = tokens.withColumn("_special", special).withColumn("_run", F.sum(breaks).over(order)).where(F.col("label").isin("B-PER", "I-PER") & ~F.col("_special"))
    found = runs.groupBy("doc_id", "chunk_id", "_run").agg(F.min_by("label", "tok_idx").alias("_first"), F.min("start").alias("start"), F.max("end").alias("end"), F.avg("conf").alias("score"))
    found = found.where((F.col("_first") == "B-PER") & (F.col("score") >= least)).select("doc_id", "chunk_id", "start", "end", "score")
    if texts is None:
        return found
    span = F.regexp_replace(F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start")), r"^\s+|\s+$", "")
    return found.join(texts, ["doc_id", "chunk_id"]).withColumn("text", span).where("text <> ''")


