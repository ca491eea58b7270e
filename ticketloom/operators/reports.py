"""Report numbers by time bucket, ordering and paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketloom.functions.predicates import status_bucket
from ticketloom.functions.scalars import round2

FAMILIES = ("conversations", "email", "chats", "customers", "users", "productivity", "ratings", "company", "docs")


def _bucket(c: str, granularity: str) -> Column:
    if granularity not in ("day", "week", "month", "quarter", "year"):
        raise ValueError(f"unknown granularity {granularity!r}")
    return F.date_trunc(granularity, F.col(c)).cast("timestamp_ntz").alias("bucket")


def report_rollup(df: DataFrame, family: str, start: Column, end: Column, granularity: str = "month", mailbox: int | None = None, view: str | None = None) -> DataFrame:
    """Numbers of one report over rows with ``start <= at < end``.

    conversations, email, chats, customers: a count for each bucket, of ``type`` for the two in the middle,
    and for each tag with ``view="tags"``. users: by agent, conversations in each of the overview's three groups
    and, where ``rows`` have ``n_replies``, replies sent. productivity: mean and median of
    first_response_minutes. ratings: a count for each rating. docs: views by article. company: totals of
    conversations, e-mails, chats, customers, agents, the three groups, and replies where there are some.
    """
    if family not in FAMILIES:
        raise ValueError(f"unknown report {family!r}")
    rows = df.where((F.col("at") >= start) & (F.col("at") < end))
    if mailbox is not None:
        rows = rows.where(F.col("mailbox_id") == mailbox)
    if family in ("email", "chats"):
        rows = rows.where(F.col("type") == {"email": "email", "chats": "chat"}[family])
    n = F.count(F.lit(1)).alias("n")
    groups = [F.count_if(status_bucket("status") == s).alias(s) for s in ("active", "pending", "closed")]
    replies = [F.coalesce(F.sum("n_replies"), F.lit(0)).cast("bigint").alias("replies")] if "n_replies" in df.columns else []
    if family == "productivity":
        m = F.col("first_response_minutes")
        # Equal values are counted first, by as many tasks as there are values, so that a bucket's task sees each value once.
        counted = rows.groupBy(_bucket("at", granularity), m.alias("_m")).agg(F.count(m).alias("_n")).groupBy("bucket")
        mean, median = F.sum(F.col("_m") * F.col("_n")) / F.sum("_n"), F.percentile("_m", 0.5, F.greatest("_n", F.lit(1)))
        return counted.agg(round2(mean).alias("avg_minutes"), round2(median).alias("median_minutes"), F.sum("_n").alias("n"))
    if family == "users":
        return rows.groupBy("agent_id").agg(*groups, *replies)
    if family == "ratings":
        return rows.groupBy("rating").agg(n)
    if family == "docs":
        return rows.groupBy("article_id").agg(F.sum("views").alias("views"))
    if family == "company":
        kinds = [F.count_if(F.col("type") == kind).alias(name) for kind, name in (("email", "emails"), ("chat", "chats"))]
        return rows.agg(n, *kinds, F.count_distinct("customer_id").alias("customers"), F.count_distinct("agent_id").alias("agents"), *groups, *replies)
    if view == "tags":
        return rows.select(_bucket("at", granularity), F.explode("tags").alias("_t")).groupBy("bucket", F.col("_t.name").alias("tag")).agg(n)
    return rows.groupBy(_bucket("at", granularity)).agg(n)


#: Sizes of sketches: 2 ** 12 registers for distinct counts (standard error 1.6 %), and KLL's k (rank error below 2 %).
HLL_BITS, KLL_K, RANK_ERROR = 12, 200, 0.02


def partial_states(df: DataFrame, value: str, distinct: str, *by: str) -> DataFrame:
    """A day's numbers in a form that merges: day, ``by``, n, total, and sketches of the values and of who is counted.

    ``df`` has ``at``. Stored by day, they give the numbers of any span of days without its rows.
    """
    v = F.col(value).cast("double")
    return df.groupBy(F.to_date("at").alias("day"), *by).agg(F.count(v).alias("n"), F.sum(v).alias("total"), F.kll_sketch_agg_double(v, F.lit(KLL_K)).alias("quantiles"), F.hll_sketch_agg(distinct, F.lit(HLL_BITS)).alias("who"))


def rolled_up(states: DataFrame, granularity: str, *by: str) -> DataFrame:
    """bucket, ``by``, n, mean (exact), median and p90 (within ``RANK_ERROR`` of their ranks), distinct (an estimate), from stored states."""
    merged = states.groupBy(_bucket("day", granularity), *by).agg(F.sum("n").alias("n"), F.sum("total").alias("_t"), F.kll_merge_agg_double("quantiles").alias("_q"), F.hll_union_agg("who").alias("_w"))
    quantile = lambda q: F.kll_sketch_get_quantile_double("_q", F.lit(q))
    return merged.select("bucket", *by, "n", (F.col("_t") / F.col("n")).alias("mean"), quantile(0.5).alias("median"), quantile(0.9).alias("p90"), F.hll_sketch_estimate("_w").alias("distinct"))


#: What may be sorted by, and the column that it means.
SORTS = {"createdAt": "created_at", "modifiedAt": "modified_at", "number": "number", "subject": "subject", "status": "status", "customerEmail": "customer.email", "customerName": "customer.last", "mailboxid": "mailbox_id", "waitingSince": "waiting_since"}


def sort_by(df: DataFrame, field: str = "createdAt", order: str = "desc") -> DataFrame:
    """By a named field, then by id. Relevance (``score``) isn't defined for tables and is an error."""
    if field not in SORTS or order not in ("asc", "desc"):
        raise ValueError(f"can't sort by {field!r} {order!r}")
    c = F.col(SORTS[field])
    return df.orderBy(c.desc() if order == "desc" else c.asc(), "id")


def page(df: DataFrame, number: int = 1, size: int = 25) -> DataFrame:
    """One page of rows that are already in order."""
    return df.offset((number - 1) * size).limit(size)


def sort_categories(df: DataFrame, by: str = "manual") -> DataFrame:
    keys = {"name": [F.col("name")], "number": [F.col("number")], "popularity": [F.desc("views")], "manual": [F.col("order")]}
    if by not in keys:
        raise ValueError(f"unknown order {by!r}")
    return df.orderBy(*keys[by], "id")
