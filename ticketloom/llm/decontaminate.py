"""Benchmark decontamination: a positional inverted index of the corpus, searched for benchmark passages.

The index is a stored table of postings: for each occurrence of a benchmark term in a document its
position, and a short hash of the word after it. A passage is searched from its rarest term: the list of
that term, with its neighbour, is shifted by the term's offset in the benchmark item, which gives candidate
alignments of item and document. The lists of all words of the item, shifted by their offsets, are then
intersected with the alignments in one join on document, position and term, and runs of consecutive words
that are all there are occurrences. Nothing but DataFrame expressions runs.

Words are compared as 64-bit hashes. A document is known by its id and the hash of its text, so repeated
ids are told apart and equal rows get equal results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketloom.llm.common import ascii_lower, boxed, held, unboxed, written

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words where A-Z are not lower-cased yet.
ANY_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 10
#: Parts of a set of documents, and bits of each: half a megabyte in all, whatever the corpus.
PARTS, BITS = 1024, 4096
RUNS = "array<struct<item_id:bigint,start:int,end:int>>"


def word_hashes(text: Column) -> Column:
    """Hashes of a text's words in order; none for null."""
    return F.transform(F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w))


def _short(h: Column) -> Column:
    return h.bitwiseAND(F.lit((1 << 31) - 1)).cast("int")


def benchmark_items(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """item (a key), item_id, words (hashes), n, starts and asked of each distinct item with words; the id may be null.

    ``starts`` are the places of its distinct windows, each at its first; ``asked`` the places and words that they
    cover. What an item repeats is looked for once.
    """
    items = held(benchmark.select("item_id", "text"), words=word_hashes(F.col("text")))
    items = items.select(F.xxhash64("item_id", "words").alias("item"), "item_id", "words", F.size("words").alias("n")).where("n > 0").distinct()
    w = F.least(F.col("n"), F.lit(window))
    grams = F.transform(F.sequence(F.lit(0), F.col("n") - w), lambda s: F.slice("words", s + 1, w))
    first = items.select("item", F.posexplode(grams).alias("s", "gram")).groupBy("item", "gram").agg(F.min("s").alias("s"))
    starts = first.groupBy(F.col("item").alias("_of")).agg(F.array_sort(F.collect_list("s")).alias("starts"))
    kept = items.withColumn("w", w).join(starts, F.col("item") == F.col("_of"))
    covered = F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(s, s + F.col("w") - 1))))
    return kept.select("item", "item_id", "words", "n", "starts", F.transform(covered, lambda i: F.struct(i.alias("i"), F.get("words", i).alias("h"))).alias("asked"))


def _keyed(docs: DataFrame) -> DataFrame:
    """Adds what a document is known by: doc (its id as text, null as empty) and th (the hash of its text)."""
    return docs.withColumns({"doc": F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "th": F.xxhash64("text")})


def build_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The stored postings (doc, th, pos, h, next) of the terms ``h`` in ``terms``."""
    df = held(_keyed(docs.select("doc_id", "text")), _h=word_hashes(F.col("text")))
    df = df.select("doc", "th", F.arrays_zip(F.col("_h").alias("h"), F.slice("_h", F.lit(2), F.size("_h")).alias("x")).alias("_z"))
    df = df.select("doc", "th", F.posexplode("_z").alias("pos", "_z")).select("doc", "th", "pos", F.col("_z.h").alias("h"), F.col("_z.x").alias("_x"))
    return written(df.join(terms, "h", "left_semi").select("doc", "th", "pos", "h", F.coalesce(_short(F.col("_x")), F.lit(-1)).alias("next")))


def anchors(items: DataFrame, index: DataFrame, window: int = WINDOW) -> DataFrame:
    """Where to look from: (item, at, h, next) with the rarest term of each window and its neighbour.

    A window with a term that no document holds can't occur and has no anchor. ``next`` is null for a
    window of one word.
    """
    found = index.groupBy("h").agg(F.count(F.lit(1)).alias("df"))
    w = F.least(F.col("n"), F.lit(window))
    grams = F.transform("starts", lambda s: F.struct(s.alias("s"), F.slice("words", s + 1, w).alias("gram")))
    starts = items.select("item", w.alias("w"), F.explode(grams).alias("_g")).select("item", "w", "_g.s", "_g.gram")
    terms = starts.select("item", "s", "w", "gram", F.posexplode("gram").alias("at", "h")).join(found, "h", "left")
    rare = terms.groupBy("item", "s", "w", "gram").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "at")).alias("r")).where("r.df > 0")
    # The last word of a window is looked up as the neighbour of the word before it.
    at = F.when(F.col("w") == 1, F.col("r.at")).otherwise(F.least(F.col("r.at"), F.col("w") - 2))
    rare = rare.select("item", "s", "w", "gram", at.alias("at"))
    return rare.select("item", (F.col("s") + F.col("at")).alias("at"), F.get(F.col("gram"), F.col("at")).alias("h"), F.when(F.col("w") > 1, _short(F.get(F.col("gram"), F.col("at") + 1))).alias("next")).distinct()


def alignments(index: DataFrame, looked: DataFrame) -> DataFrame:
    """Candidate alignments (doc, th, item, shift): item word i would be document word shift + i."""
    found = index.withColumnRenamed("next", "_after").join(looked, "h").where(F.col("next").isNull() | (F.col("next") == F.col("_after")))
    return found.select("doc", "th", "item", (F.col("pos") - F.col("at")).alias("shift")).distinct()


def among(index: DataFrame, found: DataFrame) -> DataFrame:
    """The postings of documents that may be among those of ``found``, by a bitmap of ``PARTS * BITS`` bits.

    The bitmap's size is fixed, so it is sent to the postings; postings that it lets through by chance find
    no partner later, and on a corpus that fills it all postings go on.
    """
    part, bit = F.pmod("th", F.lit(PARTS)), F.pmod(F.shiftright("th", 10), F.lit(BITS)).cast("int")
    word, at = F.shiftright(bit, 6), F.pmod(bit, F.lit(64))
    words = found.select(part.alias("_part"), word.alias("_word"), at.alias("_at")).distinct().groupBy("_part", "_word").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("_at"))).alias("_bits"))
    maps = written(words.groupBy("_part").agg(F.map_from_entries(F.collect_list(F.struct("_word", "_bits"))).alias("_map")).select("_part", F.transform(F.sequence(F.lit(0), F.lit(BITS // 64 - 1)), lambda k: F.coalesce(F.element_at("_map", k), F.lit(0).cast("bigint"))).alias("_map")))
    some = index.withColumn("_part", part).join(F.broadcast(maps), "_part")
    return some.where(F.getbit(F.get(F.col("_map"), word), at) == 1).select(index.columns)


def occurrences(index: DataFrame, found: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc, th, item_id, start, end) of the maximal runs of a window's length or more in which item and document agree.

    Each alignment asks for the words of its item's distinct windows at their shifted places; the join with the
    postings keeps those that are there, and what stands in a row is a run.
    """
    asked = found.join(items, "item").select("doc", "th", "item", "item_id", "shift", F.least("n", F.lit(window)).alias("w"), F.explode("asked").alias("_a"))
    asked = asked.select("doc", "th", "item", "item_id", "shift", "w", F.col("_a.i").alias("i"), F.col("_a.h").alias("h"))
    there = asked.withColumn("pos", F.col("shift") + F.col("i")).join(among(index.select("doc", "th", "pos", "h"), found), ["doc", "th", "pos", "h"])
    # Of documents that are there twice the postings are too, so ranks are dense.
    order = Window.partitionBy("doc", "th", "item", "shift").orderBy("i")
    runs = there.withColumn("run", F.col("i") - F.dense_rank().over(order)).groupBy("doc", "th", "item", "item_id", "shift", "w", "run").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("end"))
    return runs.where(F.col("end") - F.col("start") >= F.col("w")).select("doc", "th", "item_id", "start", "end")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Adds n_words, n_hit, n_items, items_sha256, contaminated and ``runs`` (item_id, start, end) to each row of ``docs``.

    A document word is hit if it lies in an occurrence of a window of a benchmark item: ``window``
    consecutive words, or all words of an item with fewer. A null or wordless text has no words, an item
    without words no windows; an empty benchmark leaves every document clean, and an empty ``docs`` gives no
    rows. Repeated rows all get their result; ids that share a window are all named. Other columns stay,
    but those named like an added one, in any case, are replaced. Passages of benchmark rows with a null
    item_id are hit like any other; there is no id to count or name. Texts and items of any length are read
    whole, and what they repeat is looked for once.
    """
    made = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "runs"]
    rows, own = boxed(docs, ["doc_id", "text"], made)
    items = written(benchmark_items(benchmark, window))
    index = build_index(docs, items.select(F.explode("words").alias("h")).distinct())
    # A written table has a known size, so that Spark can send it to the postings instead of dealing those out.
    looked = written(anchors(items, index, window))
    found = occurrences(index, written(alignments(index, looked)), items, window)
    by_doc = found.groupBy("doc", "th").agg(F.sort_array(F.collect_set(F.struct(F.col("item_id").cast("bigint").alias("item_id"), "start", "end"))).alias("runs"))
    df = _keyed(rows).withColumn("n_words", F.coalesce(F.regexp_count("text", F.lit(ANY_WORD)), F.lit(0)).cast("bigint"))
    df = df.join(by_doc, ["doc", "th"], "left").withColumn("runs", F.coalesce("runs", F.array().cast(RUNS)))
    spans = F.sort_array(F.transform("runs", lambda r: F.struct(r.start.alias("start"), r.end.alias("end"))))
    covered = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit(0).cast("bigint").alias("n")), lambda a, r: F.struct(F.greatest(a.at, r.end).alias("at"), (a.n + F.greatest(r.end - F.greatest(a.at, r.start), F.lit(0))).alias("n")), lambda a: a.n)
    df = held(df, n_hit=covered, _items=F.sort_array(F.array_distinct(F.array_compact(F.transform("runs", lambda r: r.item_id.cast("string"))))))
    return unboxed(
        df,
        own,
        n_words=F.col("n_words"),
        n_hit=F.col("n_hit"),
        n_items=F.size("_items").cast("bigint"),
        items_sha256=F.sha2(F.array_join("_items", ","), 256),
        contaminated=F.col("n_hit") > 0,
        runs=F.col("runs"),
    )


def proximity_matches(index: DataFrame, terms: DataFrame, span: int) -> DataFrame:
    """(query_id, doc, th, start) where all terms of a query (query_id, h) lie within ``span`` words from ``start``, in any order."""
    need = terms.distinct().groupBy("query_id").agg(F.count(F.lit(1)).alias("need"))
    hits = index.join(terms.distinct(), "h").join(need, "query_id")
    near = Window.partitionBy("query_id", "doc", "th").orderBy("pos").rangeBetween(0, span - 1)
    return hits.withColumn("_n", F.size(F.collect_set("h").over(near))).where("_n = need").select("query_id", "doc", "th", F.col("pos").alias("start"))


def near_passages(docs: DataFrame, benchmark: DataFrame, terms: int = 3, span: int = 30) -> DataFrame:
    """item_id, doc_id and n_places for documents that hold an item's ``terms`` rarest words within ``span`` words, in any order.

    The rarest of an item's words are those that the documents hold least often, ties by the word; words that
    no document holds don't count, and items with fewer words are searched with those they have. A place is
    an occurrence of one of the words from which on all lie within the span. Nulls, empty and repeated rows,
    odd names and empty tables are treated as in ``contamination``; documents without a place have no row.
    """
    said = F.regexp_extract_all(ascii_lower(F.coalesce("text", F.lit(""))), F.lit(WORD), F.lit(0))
    words = benchmark.where(F.col("item_id").isNotNull()).select("item_id", F.explode(F.array_distinct(said)).alias("w")).distinct().withColumn("h", F.xxhash64("w"))
    words = written(words)
    found = held(docs.select("text"), _h=word_hashes(F.col("text"))).select(F.explode("_h").alias("h")).join(words.select("h").distinct(), "h", "left_semi")
    order = Window.partitionBy("item_id").orderBy("df", "w")
    rare = words.join(found.groupBy("h").agg(F.count(F.lit(1)).alias("df")), "h").withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= terms)
    rare = written(rare.select(F.col("item_id").alias("query_id"), "h"))
    places = proximity_matches(build_index(docs, rare.select("h").distinct()), rare, span)
    kind = docs.schema["doc_id"].dataType
    return places.groupBy(F.col("query_id").alias("item_id"), F.nullif("doc", F.lit("")).cast(kind).alias("doc_id")).agg(F.count_distinct("th", "start").alias("n_places"))
