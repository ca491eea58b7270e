"""List views: the columns that are shown for each kind of record, in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketloom.functions.scalars import assignee_display, blank_to_null, customer_display, full_name, joined, relative_time, text_or_empty, thread_body, truncate

# The columns of each view that shows them as they are, renamed where a pair stands.
PLAIN: dict[str, list[str | tuple[str, str]]] = {
    "attachments": ["id", "filename", ("mimeType", "mime"), "size"],
    "customers": ["id", ("firstName", "first_name"), ("lastName", "last_name"), "email", ("createdAt", "created")],
    "customer": ["id", ("firstName", "first_name"), ("lastName", "last_name"), "email", "phone", ("createdAt", "created")],
    "users": ["id", ("firstName", "first_name"), ("lastName", "last_name"), "email", "role"],
    "user": ["id", ("firstName", "first_name"), ("lastName", "last_name"), "email", "role", "type"],
    "user_statuses": ["id", "name", "color"],
    "teams": ["id", "name"],
    "organizations": ["id", "name", "domain"],
    "organization_conversations": ["id", "number", "subject", "status"],
    "properties": ["id", "name", "type"],
    "mailboxes": ["id", "name", "email", "slug"],
    "folders": ["id", "name", "type"],
    "custom_fields": ["id", "name", "type"],
    "tags": ["id", "name", "slug", "color"],
    "ratings": ["id", "rating", "comments"],
    "workflows": ["id", "name", "type", "status", ("mailboxId", "mailbox_id")],
    "saved_replies": ["id", "name", "subject", "private"],
    "articles": ["id", "name", "slug", "status", "collectionId"],
    "article": ["id", "name", "slug", "status", "collectionId", "updatedAt"],
    "related_articles": ["id", "name", "slug", "status"],
    "revisions": ["id", "articleId", "createdBy", "createdAt"],
    "sites": ["id", "subdomain", "title", "status"],
    "site": ["id", "subdomain", "title", "status", "cname"],
    "collections": ["id", "name", "slug", "visibility", "siteId"],
    "categories": ["id", "name", "slug", "visibility", "order"],
    "category": ["id", "name", "slug", "visibility", "order", "collectionId"],
    "redirects": ["id", "siteId", "urlMapping", "redirect"],
}


def view(df: DataFrame, resource: str) -> DataFrame:
    """The plain view of a kind of record; an unknown kind is an error."""
    if resource not in PLAIN:
        raise ValueError(f"no view {resource!r}")
    return df.select(*[F.col(c) if isinstance(c, str) else F.col(c[0]).alias(c[1]) for c in PLAIN[resource]])


def conversation_list(df: DataFrame, as_of: Column) -> DataFrame:
    return df.select("id", "number", truncate("subject", 50).alias("subject"), "status", customer_display("customer").alias("customer"), assignee_display("assignee").alias("assigned"), relative_time("updated_at", as_of).alias("updated"))


def conversation_export(df: DataFrame) -> DataFrame:
    return df.select("id", "number", "subject", "status", "type", customer_display("customer").alias("customer"), assignee_display("assignee").alias("assignee"), joined("tags", "name", ";").alias("tags"), F.col("created_at").alias("created"), F.col("updated_at").alias("updated"))


def conversation_detail(df: DataFrame) -> DataFrame:
    source = F.concat_ws(" ", F.col("source.type"), F.col("source.via"))
    return df.select("id", "number", "subject", "status", "type", "mailbox_id", customer_display("customer").alias("customer"), assignee_display("assignee").alias("assignee"), joined("tags", "name", ", ").alias("tags"), source.alias("source"), F.col("created_at").alias("created"), F.col("updated_at").alias("updated"), F.col("closed_at").alias("closed"), "preview")


def thread_list(df: DataFrame) -> DataFrame:
    author = text_or_empty(F.coalesce(blank_to_null("createdBy.email"), full_name("createdBy.first", "createdBy.last")))
    return df.select("id", "type", author.alias("created_by"), F.col("createdAt").alias("created_at"), truncate(thread_body("body", "action.text"), 80).alias("body"))


def team_member_list(df: DataFrame) -> DataFrame:
    return df.select("id", full_name("firstName", "lastName").alias("name"), "email", "role")


def organization_customer_list(df: DataFrame) -> DataFrame:
    return df.select("id", full_name("firstName", "lastName").alias("name"), "email")


def webhook_list(df: DataFrame) -> DataFrame:
    return df.select("id", "url", "state", truncate(joined("events", None, ", "), 60).alias("events"))


def saved_reply(df: DataFrame) -> DataFrame:
    return df.select("id", "name", "subject", "private", truncate("text", 80).alias("text"))
