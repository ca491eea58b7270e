"""Cleaning of landed records: noise becomes null, so that JSON output leaves it out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketloom.functions.predicates import is_sentinel
from ticketloom.functions.scalars import blank_to_null, format_person, html_to_markdown


def drop_empty(df: DataFrame, strings: bool = True) -> DataFrame:
    """Empty arrays, and empty strings unless they are wanted, become null."""
    def cleaned(f: T.StructField) -> Column:
        if isinstance(f.dataType, T.ArrayType):
            return F.when(F.size(f.name) > 0, F.col(f.name)).alias(f.name)
        return blank_to_null(f.name).alias(f.name) if strings and isinstance(f.dataType, T.StringType) else F.col(f.name)

    return df.select(*[cleaned(f) for f in df.schema.fields])


def hoist_embedded(df: DataFrame) -> DataFrame:
    """Non-empty arrays of ``_embedded`` become columns; of equal names the embedded one counts where it has items."""
    if "_embedded" not in df.columns:
        return df
    inner = [f.name for f in df.schema["_embedded"].dataType.fields if isinstance(f.dataType, T.ArrayType)]
    full = {n: F.when(F.size(F.col("_embedded")[n]) > 0, F.col("_embedded")[n]) for n in inner}
    own = [F.coalesce(full[c], F.col(c)).alias(c) if c in full else F.col(c) for c in df.columns if c != "_embedded"]
    return df.select(*own, *[c.alias(n) for n, c in full.items() if n not in df.columns])


def clean_attachments(c: Column) -> Column:
    return F.transform(c, lambda a: F.struct(*[a[n].alias(n) for n in ("id", "filename", "mimeType", "size")]))


def clean_attachment_items(df: DataFrame) -> DataFrame:
    return df.drop("_links", "state", "width", "height")


def _without(c: Column, *values: str) -> Column:
    return F.when(~F.coalesce(c, F.lit("")).isin(*values), c)


def clean_thread(t: Column) -> Column:
    """A thread struct without noise: persons as text, the action's text for line items, Markdown bodies for all others."""
    line = t["type"] == "lineitem"
    files = F.coalesce(F.when(F.size(t["_embedded"]["attachments"]) > 0, clean_attachments(t["_embedded"]["attachments"])), clean_attachments(t["attachments"]))
    dull = t["action"].isNull() | (F.coalesce(t["action"]["type"], F.lit("")).isin("default") & (F.coalesce(t["action"]["text"], F.lit("")) == ""))
    return F.struct(
        t["id"].alias("id"),
        blank_to_null(t["type"]).alias("type"),
        blank_to_null(t["status"]).alias("status"),
        _without(t["state"], "published", "").alias("state"),
        blank_to_null(F.when(line, t["body"]).otherwise(html_to_markdown(t["body"]))).alias("body"),
        blank_to_null(t["createdAt"]).alias("createdAt"),
        F.when(t["createdBy"].isNotNull(), blank_to_null(format_person(t["createdBy"]))).alias("from"),
        F.when(t["assignedTo"].isNotNull(), blank_to_null(format_person(t["assignedTo"]))).alias("assignedTo"),
        F.when(F.size(files) > 0, files).alias("attachments"),
        F.when(~line, t["source"]).alias("source"),
        F.when(line, blank_to_null(t["action"]["text"])).when(~dull, F.to_json(t["action"])).alias("action"),
    )


def clean_conversation(df: DataFrame) -> DataFrame:
    """One projection over rows of the conversation schema."""
    threads = F.col("_embedded")["threads"]
    waiting = F.coalesce(F.col("customerWaitingSince")["time"])
    out = df.select(
        "id", "number", "subject", "status",
        _without(F.col("state"), "published").alias("state"),
        "type", "mailboxId", "createdAt", F.col("userUpdatedAt").alias("updatedAt"), "closedAt", "preview",
        format_person("primaryCustomer").alias("customer"),
        F.when(F.col("assignee").isNotNull(), format_person("assignee")).alias("assignee"),
        F.when(F.col("closedBy") != 0, F.col("closedBy")).alias("closedBy"),
        F.when(F.col("closedByUser").isNotNull() & ~is_sentinel("closedByUser"), format_person("closedByUser")).alias("closedByUser"),
        waiting.alias("customerWaitingSince"),
        F.when(~F.coalesce(F.size(threads) > 0, F.lit(False)), F.col("threads")).alias("threadCount"),
        F.when(F.size(threads) > 0, F.transform(threads, clean_thread)).alias("threads"),
        "tags", "customFields", "cc", "bcc", "source",
    )
    return drop_empty(out)


def clean_customer(df: DataFrame) -> DataFrame:
    out = hoist_embedded(df.drop("_links", "photoUrl"))
    out = out.withColumn("gender", _without(F.col("gender"), "Unknown", "")).withColumn("draft", F.when(F.col("draft"), F.col("draft"))).withColumn("photoType", _without(F.col("photoType"), "default", ""))
    return drop_empty(out)


def clean_user(df: DataFrame) -> DataFrame:
    return drop_empty(df.drop("_links", "photoUrl"))


def clean_organization(df: DataFrame) -> DataFrame:
    """Empty strings stay."""
    return drop_empty(df.drop("_links"), strings=False)


def clean_saved_reply(df: DataFrame) -> DataFrame:
    return df.drop("_links").withColumn("text", html_to_markdown("text"))


def clean_minimal(df: DataFrame) -> DataFrame:
    return df.drop("_links")
