"""Ranked search in texts: a stored inverted index with term frequencies, Boolean conditions, BM25, and the best results by score bounds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketloom.scratch import dealt, shared_path, written

TERM = r"[\p{L}\p{N}]+"
K1, B = 1.2, 0.75


def terms_of(text: Column) -> Column:
    """The words of a text, in lower case; none for null."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TERM), F.lit(0))


@dataclass(frozen=True)
class Index:
    """``postings``: term, id, tf, length (words of the document); ``terms``: term, idf, bound (the most that it can add to a score); ``mean``: words of a document on average."""

    postings: DataFrame
    terms: DataFrame
    mean: float

    def weighed(self) -> DataFrame:
        """The postings with ``weight``: what the term adds to a score, before its rarity."""
        return self.postings.withColumn("weight", _weight(self.mean))


def _weight(mean: float) -> Column:
    return F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / mean))


def build_index(docs: DataFrame, id_column: str, *columns: str) -> Index:
    """The index of the words of text columns, as stored tables.

    Each row is a document. Words are counted where a row is read, so each posting is dealt out once; a file of
    postings is sorted by term, so that a search reads the pages of its terms alone. Rows without words aren't in
    the index and don't count.
    """
    path = shared_path(docs.sparkSession)
    words = F.flatten(F.array(*[terms_of(F.col(c)) for c in columns]))
    rows = dealt(docs.select(F.col(id_column).alias("id"), *columns)).select("id", words.alias("_w")).select("id", F.size("_w").alias("length"), F.posexplode("_w").alias("_at", "term"))
    counted = rows.groupBy("term", "id", "length").agg(F.count(F.lit(1)).cast("int").alias("tf"), F.max(F.col("_at") == 0).alias("lead"))
    counted = written(counted.sortWithinPartitions("term", "id"), f"{path}/postings")
    # Each document has one posting that leads.
    whole = counted.agg(F.count_if("lead").alias("n"), F.sum(F.when(F.col("lead"), F.col("length"))).alias("words")).first()
    n, mean = whole.n, (whole.words or 1) / (whole.n or 1)
    idf = F.log(1 + (F.lit(n) - F.count(F.lit(1)) + 0.5) / (F.count(F.lit(1)) + 0.5))
    terms = counted.groupBy("term").agg(idf.alias("idf"), (idf * F.max(_weight(mean))).alias("bound"))
    return Index(counted.drop("lead"), written(terms.sortWithinPartitions("term"), f"{path}/terms"), mean)


def search(index: Index, queries: DataFrame, k: int = 25) -> DataFrame:
    """(query_id, id, rank, score): the ``k`` best documents of each query, by BM25, ties by id.

    ``queries``: query_id, term, need: ``must`` (the document has it), ``should`` (it adds to the score) or
    ``not`` (the document doesn't have it). A query with ``must`` terms finds what has all of them, one without
    what has any of its ``should`` terms. A term that stands twice in a query counts once, by the strictest need.

    A query's terms are ordered by the most that they can add. The best ``k`` by the first term alone bound what
    a result must reach; where the rest from some term on can't reach that together, documents with none of the
    terms before it are left out before scores are summed. Ties at the bound stay, so results are exact.
    """
    rank_of = F.when(F.col("need") == "not", 0).when(F.col("need") == "must", 1).otherwise(2)
    asked = queries.groupBy("query_id", F.lower("term").alias("term")).agg(F.min_by("need", rank_of).alias("need"))
    musts = asked.where("need = 'must'").groupBy("query_id").agg(F.count(F.lit(1)).alias("n_must"))
    known = asked.join(index.terms, "term")
    adds = written(known.where("need <> 'not'"))
    by_bound = Window.partitionBy("query_id").orderBy(F.desc("bound"), "term")
    adds = adds.withColumns({"nth": F.row_number().over(by_bound), "rest": F.sum("bound").over(by_bound.rowsBetween(0, Window.unboundedFollowing))})
    postings = index.weighed()
    out = index.postings.join(known.where("need = 'not'").select("query_id", "term"), "term").select(F.col("query_id").alias("_q"), F.col("id").alias("_i"))
    allowed = lambda df: df.join(out, (F.col("query_id") == F.col("_q")) & F.col("id").eqNullSafe(F.col("_i")), "left_anti")
    first = allowed(postings.join(adds.where("nth = 1").select("query_id", "term", "idf"), "term")).select("query_id", (F.col("idf") * F.col("weight")).alias("score"))
    best = first.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))).where(F.col("r") == k).select("query_id", F.col("score").alias("least"))
    # With must terms a document needs them all, and with the first term alone it may lack some, so only the other queries have a bound.
    best = best.join(musts, "query_id", "left_anti")
    adds = adds.join(best, "query_id", "left").withColumn("essential", F.col("least").isNull() | (F.col("rest") * (1 + 1e-9) >= F.col("least")))
    adds = written(adds.select("query_id", "term", "need", "idf", "essential"))
    hits = postings.join(adds, "term").select("query_id", "id", "need", "essential", (F.col("idf") * F.col("weight")).alias("score"))
    summed = hits.groupBy("query_id", "id").agg(F.sum("score").alias("score"), F.max("essential").alias("essential"), F.count_if(F.col("need") == "must").alias("has"))
    found = summed.join(musts, "query_id", "left").where(F.col("essential") & (F.col("has") == F.coalesce("n_must", F.lit(0))))
    found = allowed(found)
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "id", "rank", F.round("score", 6).alias("score"))
