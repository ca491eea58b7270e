"""Briefing metrics: workload by agent, and how each conversation stands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketloom.functions.predicates import is_customer_facing, is_open, status_bucket
from ticketloom.functions.scalars import blank_to_null, format_bytes, format_person, full_name, html_to_markdown, round2, seconds_between, text_or_empty, thread_body

UNASSIGNED = "(unassigned)"


def briefing_scope(conv: DataFrame, as_of: Column, assigned_to: int | None = None) -> DataFrame:
    """Active, pending, and conversations closed that changed in the last seven days: one scan with one predicate."""
    recent = F.col("modified_at") > as_of - F.expr("INTERVAL 7 DAYS")
    out = conv.where(F.col("status").isin("active", "pending") | ((F.col("status") == "closed") & recent))
    return out if assigned_to is None else out.where(F.col("assignee.id") == assigned_to)


def _counts() -> list[Column]:
    bucket = status_bucket("status")
    return [F.count_if(bucket == b).alias(b) for b in ("active", "pending", "closed")]


def team_overview(conv: DataFrame) -> DataFrame:
    """id, agent, email and open, pending and closed counts for each agent, busiest first; then the unassigned, if any.

    Agents are told apart by e-mail, by name where it is empty; id and name are those of the smallest id.
    One shuffle of partial counts by agent.
    """
    a = F.col("assignee")
    name = full_name(a["first"], a["last"])
    key = F.when(a.isNotNull(), F.coalesce(blank_to_null(a["email"]), name))
    first = F.min(F.struct(a["id"].alias("id"), name.alias("name"), text_or_empty(a["email"]).alias("email")))
    found = conv.groupBy(key.alias("_key")).agg(first.alias("_who"), *_counts())
    nobody = F.col("_key").isNull()
    shown = found.select(
        F.when(~nobody, F.col("_who.id")).alias("id"),
        F.when(nobody, UNASSIGNED).otherwise(F.coalesce(blank_to_null("_who.name"), F.col("_who.email"))).alias("agent"),
        F.when(nobody, "").otherwise(F.col("_who.email")).alias("email"),
        "active", "pending", "closed", nobody.alias("_last"),
    )
    return shown.orderBy("_last", F.desc("active"), "agent", "id").drop("_last")


def team_totals(conv: DataFrame) -> DataFrame:
    return conv.agg(*_counts())


def agent_header(conv: DataFrame, user_id: int) -> DataFrame:
    """Counts and the name of one agent; ``Unknown`` if there are rows but no name, null without rows."""
    rows = conv.where(F.col("assignee.id") == user_id)
    name = blank_to_null(full_name("assignee.first", "assignee.last"))
    return rows.agg(F.min_by(name, F.when(name.isNotNull(), F.col("id"))).alias("_n"), F.count(F.lit(1)).alias("_rows"), *_counts()).select(
        F.when(F.col("_rows") > 0, F.coalesce("_n", F.lit("Unknown"))).alias("agent"), F.col("active").alias("open"), "pending", "closed"
    )


def _metrics(as_of: Column, created: Column) -> list[Column]:
    """From aggregates named with an underscore to the metrics, times as timestamps."""
    minutes = seconds_between(created, F.col("_first_at")) / 60
    return [
        F.coalesce("_n", F.lit(0)).cast("bigint").alias("thread_count"),
        text_or_empty("_last_activity").alias("last_activity"),
        text_or_empty("_last_by").alias("last_by"),
        (text_or_empty("_last_by") == "customer").alias("awaiting_reply"),
        F.coalesce("_files", F.lit(0)).cast("bigint").alias("attachment_count"),
        (F.coalesce("_files", F.lit(0)) > 0).alias("has_attachments"),
        round2(minutes).alias("first_response_minutes"),
        round2(seconds_between(created, as_of) / 3600 / 24).alias("age_days"),
    ]


def conversation_summary(conv: DataFrame, threads: DataFrame, as_of: Column) -> DataFrame:
    """One row for each conversation (id, created_at timestamp) from its threads (conv_id, pos, type, created_at text, created_ts timestamp, n_attachments).

    Order is that of ``pos``, not of time. The first response is the first thread that isn't the
    customer's, notes included; where its time is unknown, so is the response time. One shuffle by
    conversation, aggregated before it.
    """
    facing, other = is_customer_facing("type"), F.col("type") != "customer"
    per = threads.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("_n"),
        F.max_by("created_at", "pos").alias("_last_activity"),
        F.max_by("type", F.when(facing, F.col("pos"))).alias("_last_by"),
        F.sum("n_attachments").alias("_files"),
        F.min_by("created_ts", F.when(other, F.col("pos"))).alias("_first_at"),
    )
    return conv.join(per, conv["id"] == per["conv_id"], "left").select(conv["id"], *_metrics(as_of, conv["created_at"]))


def nested_summary(conv: DataFrame, as_of: Column) -> DataFrame:
    """The same for conversations that hold their threads: no shuffle."""
    t = F.coalesce("threads", F.array().cast(conv.schema["threads"].dataType))
    facing = F.filter(t, lambda x: is_customer_facing(x["type"]))
    df = conv.select(
        "id", "created_at",
        F.size(t).alias("_n"),
        F.try_element_at(t, F.lit(-1))["created_at"].alias("_last_activity"),
        F.try_element_at(facing, F.lit(-1))["type"].alias("_last_by"),
        F.aggregate(t, F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x["n_attachments"].cast("bigint"), F.lit(0))).alias("_files"),
        F.get(F.filter(t, lambda x: x["type"] != "customer"), F.lit(0))["created_ts"].alias("_first_at"),
    )
    return df.select("id", *_metrics(as_of, F.col("created_at")))


def threads_by_type(threads: DataFrame) -> DataFrame:
    return threads.groupBy("conv_id", "type").agg(F.count(F.lit(1)).alias("threads"))


def threads_by_type_map(types: Column) -> Column:
    """The same as a map, for an array of types."""
    return F.map_from_entries(F.transform(F.array_distinct(types), lambda t: F.struct(t, F.size(F.filter(types, lambda x: x == t)))))


def page_info(df: DataFrame, size: int = 25) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total_elements")).withColumn("total_pages", F.ceil(F.col("total_elements") / size).cast("bigint"))


def agent_card(conv: DataFrame, summary: DataFrame | None = None, with_threads: bool = False) -> DataFrame:
    """What an agent sees of each open conversation: who, what, tags, the summary and, if asked for, its threads."""
    cards = conv.where(is_open("status")) if summary is None else conv.where(is_open("status")).join(summary, "id", "left")
    metrics = [] if summary is None else [F.struct(*[c for c in summary.columns if c != "id"]).alias("summary")]
    files = lambda t: F.transform(t["attachments"], lambda a: F.struct(a["id"].alias("id"), F.concat(a["filename"], F.lit(" ("), format_bytes(a["size"]), F.lit(")")).alias("file")))
    card = lambda t: F.struct(t["id"].alias("id"), t["type"].alias("type"), format_person(t["createdBy"]).alias("from"), html_to_markdown(thread_body(t["body"], t["action"]["text"])).alias("body"), t["createdAt"].alias("createdAt"), files(t).alias("attachments"))
    threads = [F.transform("threads", card).alias("threads")] if with_threads else []
    return cards.select("id", "number", "subject", "status", format_person("customer").alias("customer"), format_person("assignee").alias("assignee"), F.transform("tags", lambda t: t["name"]).alias("tags"), *metrics, *threads)
