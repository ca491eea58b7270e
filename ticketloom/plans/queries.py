"""Queries over the driver's tables for each operator, and the SQL that gives the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketloom.functions import patterns, pseudonyms
from ticketloom.functions import predicates as p
from ticketloom.functions import scalars as x
from ticketloom.operators import briefing, changes, cleaning, names, redaction, relations, reports, search, views
from ticketloom.plans import entities as e
from ticketloom.sources import pages as page_sources
from ticketloom.scratch import dealt, shared_path, written
from ticketloom.sources import sinks
from ticketloom.sources.keyed import KeyedTable, load_changes
from ticketloom.streaming import overview as overviews
from ticketloom.streaming.redact import redact_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return add


AS_OF = f"TIMESTAMP '{e.AS_OF}'"
COUNTS = "count(*) FILTER (status NOT IN ('pending', 'closed')) AS active, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'closed') AS closed"

# --- briefing ---


@query(f"WITH {e.AGENTS}, {e.CONV} SELECT a.id AS id, coalesce(a.first || ' ' || a.last, '(unassigned)') AS agent, coalesce(a.email, '') AS email, {COUNTS} FROM conv LEFT JOIN agents a ON a.id = conv.agent_id GROUP BY a.id, a.first, a.last, a.email")
def team_overview(spark: SparkSession, sf: str) -> DataFrame:
    return briefing.team_overview(e.conversations(spark, sf))


@query(f"WITH {e.CONV} SELECT {COUNTS} FROM conv")
def team_totals(spark: SparkSession, sf: str) -> DataFrame:
    return briefing.team_totals(e.flat_conversations(spark, sf))


@query(f"WITH {e.AGENTS}, {e.CONV} SELECT min(a.first || ' ' || a.last) AS agent, count(*) FILTER (status NOT IN ('pending', 'closed')) AS open, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'closed') AS closed FROM conv JOIN agents a ON a.id = conv.agent_id WHERE a.id = 7")
def agent_header(spark: SparkSession, sf: str) -> DataFrame:
    return briefing.agent_header(e.conversations(spark, sf), 7)


SCOPE = f"(status IN ('active', 'pending') OR (status = 'closed' AND modified_at > {AS_OF} - INTERVAL 7 DAY))"


@query(f"WITH {e.CONV} SELECT id, status, modified_at FROM conv WHERE {SCOPE}")
def briefing_scope(spark: SparkSession, sf: str) -> DataFrame:
    return briefing.briefing_scope(e.flat_conversations(spark, sf), e.as_of()).select("id", "status", "modified_at")


SUMMARY = """SELECT conv_id AS id, count(*) AS thread_count, max_by(created_at, pos) AS last_activity,
  coalesce(max_by(type, pos) FILTER (type IN ('customer', 'reply', 'message', 'chat', 'phone', 'beaconchat')), '') AS last_by,
  coalesce(max_by(type, pos) FILTER (type IN ('customer', 'reply', 'message', 'chat', 'phone', 'beaconchat')), '') = 'customer' AS awaiting_reply,
  CAST(sum(n_attachments) AS BIGINT) AS attachment_count, sum(n_attachments) > 0 AS has_attachments,
  round((epoch_us(min_by(ts, pos) FILTER (type <> 'customer')) - epoch_us(min(ts))) / 1000000 / 60, 2) AS first_response_minutes,
  round((epoch_us(TIMESTAMP '2024-03-01 00:00:00') - epoch_us(min(ts))) / 1000000 / 3600 / 24, 2) AS age_days FROM ethreads GROUP BY conv_id"""


@query(f"WITH {e.TIMED_THREADS} {SUMMARY}")
def conversation_summary(spark: SparkSession, sf: str) -> DataFrame:
    conv, threads = e.timed_threads(spark, sf)
    return briefing.conversation_summary(conv, threads, F.to_timestamp_ntz(F.lit("2024-03-01 00:00:00")))


@query(f"WITH {e.TIMED_THREADS} {SUMMARY}")
def nested_summary(spark: SparkSession, sf: str) -> DataFrame:
    conv, threads = e.timed_threads(spark, sf)
    return briefing.nested_summary(relations.embed_threads(conv, threads), F.to_timestamp_ntz(F.lit("2024-03-01 00:00:00")))


@query(f"WITH {e.TIMED_THREADS} SELECT conv_id, type, count(*) AS threads FROM ethreads GROUP BY conv_id, type")
def threads_by_type(spark: SparkSession, sf: str) -> DataFrame:
    return briefing.threads_by_type(e.timed_threads(spark, sf)[1])


@query(f"WITH {e.TIMED_THREADS} SELECT conv_id, type, count(*) AS threads FROM ethreads GROUP BY conv_id, type")
def threads_by_type_map(spark: SparkSession, sf: str) -> DataFrame:
    conv, threads = e.timed_threads(spark, sf)
    nested = relations.embed_threads(conv, threads)
    return nested.select(F.col("id").alias("conv_id"), F.explode(briefing.threads_by_type_map(F.transform("threads", lambda t: t["type"]))).alias("type", "threads")).withColumn("threads", F.col("threads").cast("bigint"))


@query("SELECT count(*) AS total_elements, CAST(ceil(count(*) / 25.0) AS BIGINT) AS total_pages FROM orders")
def page_info(spark: SparkSession, sf: str) -> DataFrame:
    return briefing.page_info(e.flat_conversations(spark, sf))


@query(f"WITH {e.AGENTS}, {e.CONV}, {e.CUSTOMERS} SELECT conv.id, number, subject, status, coalesce(\"firstName\" || ' ' || \"lastName\" || ' (' || c.email || ')', '') AS customer, coalesce(a.first || ' ' || a.last || ' (' || a.email || ')', '') AS assignee, tag AS tags FROM conv LEFT JOIN agents a ON a.id = agent_id LEFT JOIN customers c ON c.id = customer_id WHERE status <> 'closed'")
def agent_cards(spark: SparkSession, sf: str) -> DataFrame:
    conv = e.with_customers(e.conversations(spark, sf), spark, sf)
    return briefing.agent_card(conv).withColumn("tags", F.array_join("tags", ","))


# --- filters: each gives the ids of the conversations that pass ---

FILTERS: dict[str, tuple[Callable[[], Column], str]] = {
    "by_status": (lambda: p.by_status("pending"), "status = 'pending'"),
    "by_status_default": (lambda: p.by_status(), "status = 'active'"),
    "by_status_all": (lambda: p.by_status("all"), "TRUE"),
    "by_mailbox": (lambda: p.by_mailbox("1,3"), "mailbox_id IN (1, 3)"),
    "by_default_mailbox": (lambda: p.by_mailbox("", 2), "mailbox_id = 2"),
    "by_folder": (lambda: p.equals("folder_id", 4), "folder_id = 4"),
    "by_tag": (lambda: p.by_tag("1-URGENT,5-LOW"), "tag IN ('1-URGENT', '5-LOW')"),
    "assigned_to": (lambda: p.assigned_to(7), "agent_id = 7"),
    "assigned_is_nobody": (lambda: p.assigned_is("Unassigned"), "agent_id IS NULL"),
    "assigned_is_name": (lambda: p.assigned_is("Agent Supplier#000000007"), "agent_id = 7"),
    "modified_since": (lambda: p.modified_since(F.to_timestamp_ntz(F.lit("2000-01-01 00:00:00"))), "modified_at > TIMESTAMP '2000-01-01'"),
    "by_number": (lambda: p.equals("number", 17), "number = 17"),
    "by_custom_fields": (lambda: p.by_custom_fields([(7, "2")], True) & p.by_mailbox("1"), "field_value = '2' AND mailbox_id = 1"),
    "subject_has": (lambda: p.has_phrase("subject", "HIGH Order"), "contains(lower(subject), 'high order')"),
    "customer_ids": (lambda: p.customer_ids([3, 5, 8, 13]), "customer_id IN (3, 5, 8, 13)"),
    "date_between": (lambda: p.date_between("modified_at", F.to_timestamp_ntz(F.lit("1999-01-01 00:00:00")), F.to_timestamp_ntz(F.lit("1999-06-30 00:00:00"))), "modified_at BETWEEN TIMESTAMP '1999-01-01' AND TIMESTAMP '1999-06-30'"),
    "date_from": (lambda: p.date_between("modified_at", F.to_timestamp_ntz(F.lit("1999-01-01 00:00:00"))), "modified_at >= TIMESTAMP '1999-01-01'"),
    "relative_since": (lambda: p.relative_since("modified_at", e.as_of(), 30, "day"), f"modified_at >= {AS_OF} - INTERVAL 30 DAY"),
    "in_month": (lambda: p.in_month("modified_at", "1999-12"), "modified_at >= TIMESTAMP '1999-12-01' AND modified_at < TIMESTAMP '2000-01-01'"),
    "and_or_not": (lambda: (p.by_status("pending") | p.equals("mailbox_id", 3)) & ~p.by_tag("5-LOW"), "(status = 'pending' OR mailbox_id = 3) AND NOT tag = '5-LOW'"),
    "is_open": (lambda: p.is_open("status"), "status <> 'closed'"),
    "by_type": (lambda: p.equals("type", "chat"), "type = 'chat'"),
}


def _filter(name: str) -> None:
    make, where = FILTERS[name]
    needs_agent = name.startswith("assigned")

    def run(spark: SparkSession, sf: str) -> DataFrame:
        conv = e.conversations(spark, sf) if needs_agent else e.flat_conversations(spark, sf)
        return conv.where(make()).select("id")

    query(f"WITH {e.CONV} SELECT id FROM conv WHERE {where}", f"filter_{name}")(run)


for _name in FILTERS:
    _filter(_name)


def _nested(spark: SparkSession, sf: str) -> DataFrame:
    threads = e.text_threads(spark, sf)
    conv = threads.groupBy(F.col("conv_id").alias("id")).agg(F.concat(F.lit("Chat "), F.first("conv_id").cast("string")).alias("subject"))
    return relations.embed_threads(conv, threads)


NESTED_FILTERS: dict[str, tuple[Callable[[], Column], str]] = {
    "body_has": (lambda: p.any_body_has("threads", "The"), "bool_or(contains(lower(body), 'the'))"),
    "free_text": (lambda: p.free_text("chat 1"), "contains(lower('Chat ' || conv_id), 'chat 1') OR bool_or(contains(lower(body), 'chat 1'))"),
    "reply_user_ids": (lambda: p.reply_user_ids([2, 4]), "bool_or(type = 'reply' AND author_id IN (2, 4))"),
    "has_attachments": (lambda: p.has_attachments(), "bool_or(has_file)"),
    "customer_facing": (lambda: F.forall("threads", lambda t: p.is_customer_facing(t["type"])), "bool_and(type IN ('customer', 'reply', 'message', 'chat', 'phone', 'beaconchat'))"),
}


def _nested_filter(name: str) -> None:
    make, having = NESTED_FILTERS[name]
    query(f"WITH {e.TEXT_THREADS} SELECT conv_id AS id FROM tthreads GROUP BY conv_id HAVING {having}", f"filter_{name}")(lambda spark, sf: _nested(spark, sf).where(make()).select("id"))


for _name in NESTED_FILTERS:
    _nested_filter(_name)


@query(f"WITH {e.CONV}, {e.CUSTOMERS} SELECT conv.id FROM conv LEFT JOIN customers c ON c.id = customer_id WHERE c.email = 'customer.000000011@example.com'")
def filter_email_is(spark: SparkSession, sf: str) -> DataFrame:
    conv = e.with_customers(e.flat_conversations(spark, sf), spark, sf).withColumn("cc", F.array(F.lit("nobody@example.com"))).withColumn("bcc", F.array().cast("array<string>"))
    return conv.where(p.email_is("customer.000000011@example.com", "cc", "bcc")).select("id")


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey = 0")
def filter_sentinel(spark: SparkSession, sf: str) -> DataFrame:
    return e.customers(spark, sf).where(p.is_sentinel(F.struct("id", "email"))).select("id")


@query(f"WITH {e.CUSTOMERS} SELECT id FROM customers WHERE \"lastName\" = 'Customer#000000042' OR contains(lower(email), '0007')")
def filter_customers(spark: SparkSession, sf: str) -> DataFrame:
    return e.customers(spark, sf).where(p.equals("lastName", "Customer#000000042") | p.has_phrase("email", "0007")).select("id")


@query(f"WITH {e.CONV} SELECT id FROM conv WHERE field_value = '2' AND mailbox_id = 3")
def filter_field_assignments(spark: SparkSession, sf: str) -> DataFrame:
    """Custom fields as they are typed: ``id=value``."""
    return e.flat_conversations(spark, sf).where(p.by_custom_fields(x.parse_assignments(["7=2"]), True) & p.by_mailbox("3")).select("id")


WORKFLOWS = "(SELECT s_suppkey AS id, s_nationkey % 5 AS mailbox_id, CASE WHEN s_nationkey % 2 = 0 THEN 'automatic' ELSE 'manual' END AS type FROM supplier)"


def _workflows(spark: SparkSession, sf: str) -> DataFrame:
    at = F.col("s_nationkey")
    return e.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), (at % 5).alias("mailbox_id"), F.when(at % 2 == 0, "automatic").otherwise("manual").alias("type"))


@query(f"SELECT id, type FROM {WORKFLOWS} WHERE mailbox_id = 2 AND type = 'manual'")
def filter_workflows(spark: SparkSession, sf: str) -> DataFrame:
    return _workflows(spark, sf).where(p.workflows(2, "manual")).select("id", "type")


@query(f"SELECT id, type FROM {WORKFLOWS}")
def filter_workflows_of_any_mailbox(spark: SparkSession, sf: str) -> DataFrame:
    return _workflows(spark, sf).where(p.workflows(0)).select("id", "type")


@query("SELECT doc_id AS id FROM documents WHERE doc_id % 5 = 3 AND (contains(lower('Reply ' || doc_id), 'tion') OR contains(lower(text), 'tion'))")
def filter_saved_replies(spark: SparkSession, sf: str) -> DataFrame:
    d = e.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("Reply "), F.col("doc_id").cast("string")).alias("name"), "text", (F.col("doc_id") % 5).alias("mailbox_id"))
    return d.where(p.saved_replies(3, "TION")).select("id")


@query("SELECT n_nationkey AS id FROM nation WHERE contains(lower(n_name), 'tion_1') OR contains(lower(n_name) || '.example.com', 'tion_1')")
def filter_organizations(spark: SparkSession, sf: str) -> DataFrame:
    n = e.table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.concat(F.lower("n_name"), F.lit(".example.com")).alias("domain"))
    return n.where(p.organizations("TION_1")).select("id")


@query("SELECT n_nationkey AS id FROM nation WHERE n_regionkey = 2 AND n_nationkey % 2 = 1")
def filter_collections(spark: SparkSession, sf: str) -> DataFrame:
    n = e.table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").cast("string").alias("site_id"), F.when(F.col("n_nationkey") % 2 == 0, "public").otherwise("private").alias("visibility"))
    return n.where(p.collections("2", "private")).select("id")


@query(f"WITH {e.ARTICLES} SELECT id FROM articles WHERE contains(lower(text), 'tion') AND status = 'published' AND site_id = 'fr' AND id % 3 = 0 AND \"collectionId\" IN (SELECT DISTINCT source FROM documents WHERE lang = 'fr' AND doc_id % 2 = 1)")
def search_articles(spark: SparkSession, sf: str) -> DataFrame:
    rows = e.articles(spark, sf).withColumn("visibility", F.when(F.col("id") % 3 == 0, "private").otherwise("public"))
    some = rows.where("site_id = 'fr' AND id % 2 = 1").select("collectionId").distinct()
    return rows.where(p.article_search("tion", None, "fr", "published", "private")).join(some, "collectionId", "left_semi").select("id")


@query(f"WITH {e.AGENTS} SELECT id FROM agents WHERE email = 'supplier.000000007@example.com'")
def filter_users(spark: SparkSession, sf: str) -> DataFrame:
    return e.agents(spark, sf).where(p.equals("email", "supplier.000000007@example.com")).select("id")


@query(f"WITH {e.ARTICLES} SELECT id FROM articles WHERE list_contains(categories, 3) AND status = 'published' AND contains(lower(text), 'the')")
def filter_articles(spark: SparkSession, sf: str) -> DataFrame:
    return e.articles(spark, sf).where(F.array_contains("categories", 3) & p.by_article_status("published") & p.has_phrase("text", "the")).select("id")


# --- views and scalars ---


@query(f"""WITH {e.AGENTS}, {e.CONV}, {e.CUSTOMERS}, d AS (SELECT conv.*, c.email AS cmail, a.first || ' ' || a.last AS aname, CAST(floor((epoch_us({AS_OF}) - epoch_us(modified_at)) / 1000000) AS BIGINT) AS s FROM conv LEFT JOIN agents a ON a.id = agent_id LEFT JOIN customers c ON c.id = customer_id)
SELECT id, number, CASE WHEN length(subject) > 50 THEN left(subject, 47) || '...' ELSE subject END AS subject, status, coalesce(cmail, '') AS customer, coalesce(aname, 'unassigned') AS assigned,
CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN (s // 60) || 'm ago' WHEN s < 86400 THEN (s // 3600) || 'h ago' WHEN s < 2592000 THEN (s // 86400) || 'd ago' WHEN s < 31536000 THEN (s // 2592000) || 'mo ago' ELSE (s // 31536000) || 'y ago' END AS updated FROM d""")
def view_conversations(spark: SparkSession, sf: str) -> DataFrame:
    return views.conversation_list(e.with_customers(e.conversations(spark, sf), spark, sf), e.as_of())


@query(f"WITH {e.AGENTS}, {e.CONV}, {e.CUSTOMERS} SELECT conv.id, number, subject, status, type, coalesce(c.email, '') AS customer, coalesce(a.first || ' ' || a.last, 'unassigned') AS assignee, tag AS tags, updated_at AS created, updated_at AS updated FROM conv LEFT JOIN agents a ON a.id = agent_id LEFT JOIN customers c ON c.id = customer_id")
def view_conversation_export(spark: SparkSession, sf: str) -> DataFrame:
    return views.conversation_export(e.with_customers(e.conversations(spark, sf), spark, sf).withColumn("created_at", F.col("updated_at")))


@query(f"WITH {e.TEXT_THREADS} SELECT conv_id * 1000 + pos AS id, type, CAST(author_id AS VARCHAR) || '@example.com' AS created_by, 'd' || pos AS created_at, CASE WHEN length(body) > 80 THEN left(body, 77) || '...' ELSE coalesce(body, '') END AS body FROM tthreads")
def view_threads(spark: SparkSession, sf: str) -> DataFrame:
    person = F.struct(F.lit("Ann").alias("first"), F.lit("Lee").alias("last"), F.concat(F.col("created_by.id").cast("string"), F.lit("@example.com")).alias("email"))
    rows = e.text_threads(spark, sf).select((F.col("conv_id") * 1000 + F.col("pos")).alias("id"), "type", person.alias("createdBy"), F.concat(F.lit("d"), F.col("pos").cast("string")).alias("createdAt"), "body", F.struct(F.lit("moved").alias("text")).alias("action"))
    return views.thread_list(rows)


@query(f"WITH {e.CUSTOMERS} SELECT id, \"firstName\" AS first_name, \"lastName\" AS last_name, email, phone, \"createdAt\" AS created FROM customers")
def view_customer(spark: SparkSession, sf: str) -> DataFrame:
    return views.view(e.customers(spark, sf), "customer")


@query(f"WITH {e.CUSTOMERS} SELECT id, \"firstName\" AS first_name, \"lastName\" AS last_name, email, \"createdAt\" AS created FROM customers")
def view_customers(spark: SparkSession, sf: str) -> DataFrame:
    return views.view(e.customers(spark, sf), "customers")


@query(f"WITH {e.AGENTS} SELECT id, first AS first_name, last AS last_name, email, 'user' AS role FROM agents")
def view_users(spark: SparkSession, sf: str) -> DataFrame:
    return views.view(e.agents(spark, sf).select("id", F.col("first").alias("firstName"), F.col("last").alias("lastName"), "email", F.col("type").alias("role")), "users")


@query(f"WITH {e.AGENTS} SELECT id, first || ' ' || last AS name, email, 'user' AS role FROM agents")
def view_team_members(spark: SparkSession, sf: str) -> DataFrame:
    return views.team_member_list(e.agents(spark, sf).select("id", F.col("first").alias("firstName"), F.col("last").alias("lastName"), "email", F.col("type").alias("role")))


@query(f"WITH {e.CUSTOMERS} SELECT id, \"firstName\" || ' ' || \"lastName\" AS name, email FROM customers")
def view_organization_customers(spark: SparkSession, sf: str) -> DataFrame:
    return views.organization_customer_list(e.customers(spark, sf))


@query("SELECT n_nationkey AS id, n_name AS name, lower(n_name) || '.example.com' AS domain FROM nation")
def view_organizations(spark: SparkSession, sf: str) -> DataFrame:
    n = e.table(spark, sf, "nation")
    return views.view(n.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.concat(F.lower("n_name"), F.lit(".example.com")).alias("domain")), "organizations")


@query(f"WITH {e.ARTICLES} SELECT id, name, slug, status, \"collectionId\" FROM articles")
def view_articles(spark: SparkSession, sf: str) -> DataFrame:
    return views.view(e.articles(spark, sf), "articles")


@query("SELECT s_suppkey AS id, 'https://hooks.example.com/' || s_suppkey AS url, 'enabled' AS state, CASE WHEN length(e) > 60 THEN left(e, 57) || '...' ELSE e END AS events FROM (SELECT *, 'convo.created, convo.assigned.' || s_nationkey || ', customer.updated.' || lower(s_name) AS e FROM supplier)")
def view_webhooks(spark: SparkSession, sf: str) -> DataFrame:
    s = e.table(spark, sf, "supplier")
    events = F.array(F.lit("convo.created"), F.concat(F.lit("convo.assigned."), F.col("s_nationkey").cast("string")), F.concat(F.lit("customer.updated."), F.lower("s_name")))
    return views.webhook_list(s.select(F.col("s_suppkey").alias("id"), F.concat(F.lit("https://hooks.example.com/"), F.col("s_suppkey").cast("string")).alias("url"), F.lit("enabled").alias("state"), events.alias("events")))


@query(r"SELECT page_id, regexp_replace(regexp_replace(html, '<[^>]*>', '', 'g'), '^\s+|\s+$', '', 'g') AS text FROM pages")
def strip_tags(spark: SparkSession, sf: str) -> DataFrame:
    return e.table(spark, sf, "pages").select("page_id", x.strip_tags("html").alias("text"))


def _markdown_sql(column: str) -> str:
    """The converter's steps for DuckDB, whose patterns have no back-references: one step for each kind of element that goes with its content."""
    out = column
    for pattern, put in x._HTML:
        each = [pattern.replace("(script|style|head)", k).replace(r"\1", k) for k in ("head", "script", "style")] if r"\1" in pattern else [pattern]
        for one in each:
            quoted, new = one.replace("'", "''"), re.sub(r"\$(\d)", r"\\\1", put).replace("'", "''")
            out = f"regexp_replace({out}, '{quoted}', '{new}', 'g')"
    return f"regexp_replace({out}, '^\\s+|\\s+$', '', 'g')"


@query(f"SELECT page_id, {_markdown_sql('html')} AS text FROM pages")
def html_to_markdown(spark: SparkSession, sf: str) -> DataFrame:
    return e.table(spark, sf, "pages").select("page_id", x.html_to_markdown("html").alias("text"))


@query("SELECT doc_id, CASE WHEN n >= 1048576 THEN printf('%.1fMB', n / 1048576.0) WHEN n >= 1024 THEN (n >> 10) || 'KB' ELSE n || 'B' END AS size FROM (SELECT doc_id, n_chars * 97 AS n FROM documents)")
def format_bytes(spark: SparkSession, sf: str) -> DataFrame:
    return e.table(spark, sf, "documents").select("doc_id", x.format_bytes(F.col("n_chars") * 97).alias("size"))


@query("SELECT event_id, ts::DATE AS day, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS parsed FROM events")
def parse_iso(spark: SparkSession, sf: str) -> DataFrame:
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return e.table(spark, sf, "events").select("event_id", x.parse_iso(F.substring(text, 1, 10)).cast("date").alias("day"), F.date_format(x.parse_iso(text), "yyyy-MM-dd HH:mm:ss").alias("parsed"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_scalar(spark: SparkSession, sf: str) -> DataFrame:
    return e.table(spark, sf, "events").select("event_id", x.json_scalar("props", "$.k").alias("k"))


@query("SELECT event_id, CASE WHEN value < 0 THEN '-' ELSE CAST(CAST(round_even(value, 0) AS BIGINT) AS VARCHAR) END AS minutes, CASE WHEN event_type IN ('click', 'signup') THEN 'customer' ELSE 'user' END AS author FROM events")
def shown_values(spark: SparkSession, sf: str) -> DataFrame:
    v = e.table(spark, sf, "events")
    kind = F.when(F.col("event_type").isin("click", "signup"), " Chat ").otherwise("reply")
    return v.select("event_id", x.shown_minutes(F.when(F.col("value") >= 0, F.col("value"))).alias("minutes"), x.thread_author_type(kind).alias("author"))


def _plain_view(resource: str, columns: list[tuple[str, str]]) -> None:
    """A plain view over customers whose fields say what they are."""
    value = {"id": "c_custkey", "siteId": "c_nationkey", "order": "c_custkey % 7"}
    sql = ", ".join(f"{value[c] if c in value else chr(39) + c + chr(39) + ' || c_custkey'} AS \"{shown}\"" for c, shown in columns)

    @query(f"SELECT {sql} FROM customer", f"view_{resource}")
    def shown(spark: SparkSession, sf: str) -> DataFrame:
        key = F.col("c_custkey").cast("string")
        fields = [F.expr(value[c]).alias(c) if c in value else F.concat(F.lit(c), key).alias(c) for c, _ in columns]
        return views.view(e.table(spark, sf, "customer").select(*fields, F.lit("hidden").alias("_links")), resource)


for _resource, _columns in views.PLAIN.items():
    if f"view_{_resource}" not in QUERIES:
        _plain_view(_resource, [(c, c) if isinstance(c, str) else c for c in _columns])


# --- sources and sinks ---


@query("SELECT source AS collection, CAST(count(*) AS INTEGER) AS total_pages, count(*) AS pages_found, CAST(sum(n) AS BIGINT) AS total_elements, CAST(sum(n) AS BIGINT) AS items_found, TRUE AS complete FROM (SELECT source, doc_id // 25 AS number, count(*) AS n FROM documents GROUP BY source, doc_id // 25) GROUP BY source")
def page_audit(spark: SparkSession, sf: str) -> DataFrame:
    d = e.table(spark, sf, "documents").groupBy(F.col("source").alias("collection"), F.floor(F.col("doc_id") / 25).alias("number")).agg(F.count(F.lit(1)).alias("items"))
    totals = d.groupBy("collection").agg(F.count(F.lit(1)).cast("int").alias("total_pages"), F.sum("items").alias("total_elements"))
    return page_sources.page_audit(d.join(totals, "collection"))


@query("SELECT c_custkey AS id, c_name AS name, c_mktsegment AS domain FROM customer")
def embedded_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Customers packed into page documents of 25 and unpacked again."""
    c = e.table(spark, sf, "customer")
    item = F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("domain"))
    packed = c.groupBy(F.floor(F.col("c_custkey") / 25)).agg(F.collect_list(item).alias("items"))
    missing = F.lit(None).cast(packed.schema["items"].dataType)
    return page_sources.embedded_items(packed.select(F.struct(missing.alias("fields"), F.col("items").alias("customFields")).alias("_embedded")), "fields", "customFields")


@query("SELECT c_custkey AS id, c_name AS name FROM customer")
def candidate_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Pages that hold their items under one of three keys, by turns."""
    c = e.table(spark, sf, "customer")
    packed = c.groupBy(F.floor(F.col("c_custkey") / 25).alias("page")).agg(F.collect_list(F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))).alias("items"))
    under = [F.when(F.col("page") % 3 == k, F.col("items")).alias(n) for k, n in enumerate(("statuses", "userStatuses", "status"))]
    return page_sources.embedded_items(packed.select(F.struct(*under).alias("_embedded")), "statuses", "userStatuses", "status")


@query("SELECT CAST(doc_id AS VARCHAR) AS id, lang AS name FROM documents")
def unwrapped_objects(spark: SparkSession, sf: str) -> DataFrame:
    """Objects that stand under a wrapper, or as the document itself."""
    d, wrapped = e.table(spark, sf, "documents"), F.col("doc_id") % 2 == 0
    inner = F.when(wrapped, F.struct(F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("name"))).alias("article")
    return page_sources.unwrap(d.select(inner, F.when(~wrapped, F.col("doc_id").cast("string")).alias("id"), F.when(~wrapped, F.col("lang")).alias("name")), "article")


@query("SELECT c_custkey::VARCHAR AS id, c_name AS name, c_mktsegment AS status FROM customer")
def docs_pages(spark: SparkSession, sf: str) -> DataFrame:
    c = e.table(spark, sf, "customer")
    item = F.struct(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("status"))
    packed = c.groupBy(F.floor(F.col("c_custkey") / 25).alias("page")).agg(F.collect_list(item).alias("items"))
    rows = packed.select(F.struct("page", "items").alias("articles"), *[F.lit(None).cast("string").alias(n) for n in ("id", "name", "status")])
    return page_sources.docs_items(rows, "articles")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus AS status, coalesce(CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_custkey AS VARCHAR) END, '') AS agent FROM orders")
def csv_rows(spark: SparkSession, sf: str) -> DataFrame:
    o = e.table(spark, sf, "orders")
    return sinks.csv_rows(o.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_custkey")).alias("agent")))


@query("""SELECT '{"id":' || o_orderkey || CASE WHEN o_orderkey % 7 <> 0 THEN ',"agent":' || o_custkey ELSE '' END || ',"status":"' || o_orderstatus || '"}' AS value FROM orders""")
def json_lines(spark: SparkSession, sf: str) -> DataFrame:
    o = e.table(spark, sf, "orders")
    return sinks.json_lines(o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_custkey")).alias("agent"), F.col("o_orderstatus").alias("status")))


# --- cleaning ---


def _person(first: str, last: str, email: str) -> Column:
    return F.struct(F.lit(5).cast("bigint").alias("id"), F.lit("user").alias("type"), F.col(first).alias("first"), F.col(last).alias("last"), F.col(email).alias("email"))


@query(f"""WITH {e.AGENTS}, {e.CONV}, {e.CUSTOMERS} SELECT conv.id, subject, status, CASE WHEN mailbox_id <> 0 THEN 'draft' END AS state, updated_at AS "updatedAt", coalesce("firstName" || ' ' || "lastName" || ' (' || c.email || ')') AS customer,
a.first || ' ' || a.last || ' (' || a.email || ')' AS assignee, CASE WHEN folder_id <> 0 THEN folder_id END AS "closedBy", updated_at AS "customerWaitingSince", CASE WHEN mailbox_id <> 1 THEN 3 END AS "threadCount"
FROM conv LEFT JOIN agents a ON a.id = agent_id LEFT JOIN customers c ON c.id = customer_id""")
def clean_conversations(spark: SparkSession, sf: str) -> DataFrame:
    from ticketloom import schemas

    conv = e.with_customers(e.conversations(spark, sf), spark, sf)
    have = {
        "id": F.col("id"), "number": F.col("number"), "subject": F.col("subject"), "status": F.col("status"), "state": F.when(F.col("mailbox_id") == 0, "published").otherwise("draft"),
        "type": F.col("type"), "mailboxId": F.col("mailbox_id"), "createdAt": F.lit(""), "userUpdatedAt": F.col("updated_at"), "closedBy": F.col("folder_id"), "threads": F.lit(3),
        "primaryCustomer": F.col("customer").withField("photoUrl", F.lit("x")), "assignee": F.col("assignee").withField("photoUrl", F.lit("x")), "cc": F.array().cast("array<string>"),
        "customerWaitingSince": F.struct(F.lit("a while").alias("friendly"), F.col("updated_at").alias("time")),
        "_embedded": F.when(F.col("mailbox_id") == 1, F.from_json(F.lit('{"threads":[{"id":1,"type":"customer","body":"<p>Hello <b>you</b></p>"}]}'), schemas.CONVERSATION["_embedded"].dataType)),
    }
    raw = conv.select(*[(have[f.name] if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.CONVERSATION.fields])
    return cleaning.clean_conversation(raw).select("id", "subject", "status", "state", "updatedAt", F.nullif("customer", F.lit("")).alias("customer"), "assignee", "closedBy", "customerWaitingSince", "threadCount")


@query(f"WITH {e.TEXT_THREADS} SELECT conv_id, pos, type, CASE WHEN pos % 2 = 1 THEN 'draft' END AS state, 'Ann (ann' || author_id || '@example.com)' AS \"from\", CASE WHEN type = 'note' THEN 'moved it' END AS action, CAST(CASE WHEN has_file THEN 1 END AS INTEGER) AS n_files FROM tthreads")
def clean_threads(spark: SparkSession, sf: str) -> DataFrame:
    from ticketloom import schemas

    rows = e.text_threads(spark, sf)
    kind = F.when(F.col("type") == "note", "lineitem").otherwise(F.col("type"))
    have = {
        "id": F.col("pos"), "type": kind, "state": F.when(F.col("pos") % 2 == 1, "draft").otherwise("published"), "body": F.lit("<p>x</p>"), "attachments": F.col("attachments"),
        "createdBy": F.struct(F.col("created_by.id").alias("id"), F.lit("user").alias("type"), F.lit("Ann").alias("first"), F.lit("").alias("last"), F.concat(F.lit("ann"), F.col("created_by.id").cast("string"), F.lit("@example.com")).alias("email"), F.lit("").alias("photoUrl")),
        "action": F.struct(F.when(F.col("type") == "note", "moved it").otherwise("").alias("text"), F.lit("default").alias("type")),
    }
    t = F.struct(*[(have[f.name] if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.THREAD.fields])
    c = rows.select("conv_id", "pos", F.col("type").alias("_t"), cleaning.clean_thread(t).alias("c"))
    return c.select("conv_id", "pos", F.col("_t").alias("type"), "c.state", "c.from", "c.action", F.size("c.attachments").alias("n_files"))


@query("SELECT c_custkey AS id, c_name AS \"lastName\", CASE WHEN c_nationkey % 2 = 0 THEN 'Female' END AS gender, CASE WHEN c_custkey % 3 = 0 THEN TRUE END AS draft, CASE WHEN c_custkey % 4 <> 0 THEN 1 END AS n_emails FROM customer")
def clean_customers(spark: SparkSession, sf: str) -> DataFrame:
    c = e.table(spark, sf, "customer")
    mail = F.when(F.col("c_custkey") % 4 != 0, F.array(F.struct(F.lit("a@example.com").alias("value")))).otherwise(F.array().cast("array<struct<value:string>>"))
    raw = c.select(F.col("c_custkey").alias("id"), F.lit("").alias("firstName"), F.col("c_name").alias("lastName"), F.when(F.col("c_nationkey") % 2 == 0, "Female").otherwise("Unknown").alias("gender"), (F.col("c_custkey") % 3 == 0).alias("draft"), F.lit("default").alias("photoType"), F.lit("u").alias("photoUrl"), F.struct(mail.alias("emails")).alias("_embedded"))
    return cleaning.clean_customer(raw).select("id", "lastName", "gender", "draft", F.size("emails").alias("n_emails"))


@query("SELECT s_suppkey AS id, CASE WHEN s_nationkey % 2 = 0 THEN s_name END AS \"lastName\", CASE WHEN s_nationkey % 3 <> 0 THEN 1 END AS n_mails, 2 AS n_columns_gone FROM supplier")
def clean_users(spark: SparkSession, sf: str) -> DataFrame:
    a = e.table(spark, sf, "supplier")
    mails = F.when(F.col("s_nationkey") % 3 != 0, F.array(F.lit("x@example.com"))).otherwise(F.array().cast("array<string>"))
    raw = a.select(F.col("s_suppkey").alias("id"), F.when(F.col("s_nationkey") % 2 == 0, F.col("s_name")).otherwise("").alias("lastName"), mails.alias("alternateEmails"), F.lit("u").alias("photoUrl"), F.lit("l").alias("_links"))
    clean = cleaning.clean_user(raw)
    return clean.select("id", "lastName", F.size("alternateEmails").alias("n_mails"), F.lit(len(raw.columns) - len(clean.columns)).alias("n_columns_gone"))


@query("SELECT n_nationkey AS id, CASE WHEN n_regionkey = 1 THEN '' ELSE n_name END AS name, CASE WHEN n_regionkey <> 2 THEN 1 END AS n_domains FROM nation")
def clean_organizations(spark: SparkSession, sf: str) -> DataFrame:
    n, at = e.table(spark, sf, "nation"), F.col("n_regionkey")
    raw = n.select(F.col("n_nationkey").alias("id"), F.when(at == 1, "").otherwise(F.col("n_name")).alias("name"), F.when(at != 2, F.array(F.lower("n_name"))).otherwise(F.array().cast("array<string>")).alias("domains"), F.lit("l").alias("_links"))
    return cleaning.clean_organization(raw).select("id", "name", F.size("domains").alias("n_domains"))


@query(f"SELECT page_id AS id, {_markdown_sql('html')} AS text FROM pages")
def clean_saved_replies(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.clean_saved_reply(e.table(spark, sf, "pages").select(F.col("page_id").alias("id"), F.col("html").alias("text"), F.lit("l").alias("_links")))


@query("SELECT event_id AS id, event_type AS name, CASE WHEN event_id % 2 = 0 THEN '' ELSE props END AS color FROM events")
def clean_minimal(spark: SparkSession, sf: str) -> DataFrame:
    """Links go, all else stays, empty texts too."""
    v = e.table(spark, sf, "events")
    return cleaning.clean_minimal(v.select(F.col("event_id").alias("id"), F.col("event_type").alias("name"), F.when(F.col("event_id") % 2 == 0, "").otherwise(F.col("props")).alias("color"), F.lit("l").alias("_links")))


@query(f"WITH {e.AGENTS}, {e.CONV}, {e.CUSTOMERS} SELECT conv.id, number, subject, status, type, mailbox_id, coalesce(c.email, '') AS customer, coalesce(a.first || ' ' || a.last, 'unassigned') AS assignee, tag AS tags, type || ' web' AS source, updated_at AS created, updated_at AS updated, NULL::VARCHAR AS closed, subject AS preview FROM conv LEFT JOIN agents a ON a.id = agent_id LEFT JOIN customers c ON c.id = customer_id")
def view_conversation_detail(spark: SparkSession, sf: str) -> DataFrame:
    conv = e.with_customers(e.conversations(spark, sf), spark, sf)
    return views.conversation_detail(conv.withColumns({"created_at": F.col("updated_at"), "closed_at": F.lit(None).cast("string"), "preview": F.col("subject"), "source": F.struct("type", F.lit("web").alias("via"))}))


# --- relations ---


@query(f"WITH {e.TEXT_THREADS} SELECT conv_id AS id, count(*) AS n, string_agg(type, ',' ORDER BY pos) AS types FROM tthreads GROUP BY conv_id")
def embed_threads(spark: SparkSession, sf: str) -> DataFrame:
    return _nested(spark, sf).select("id", F.size("threads").cast("bigint").alias("n"), F.array_join(F.transform("threads", lambda t: t["type"]), ",").alias("types"))


@query(f"WITH {e.TEXT_THREADS} SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY pos) - 1 AS INTEGER) AS pos, type, length(body) AS n FROM tthreads")
def flatten_threads(spark: SparkSession, sf: str) -> DataFrame:
    nested = _nested(spark, sf).select("id", F.transform("threads", lambda t: F.struct(t["type"].alias("type"), t["body"].alias("body"))).alias("threads"))
    return relations.flatten_threads(nested).select("conv_id", "pos", "type", F.length("body").cast("bigint").alias("n"))


@query(f"WITH {e.TEXT_THREADS} SELECT conv_id, file_id AS id, filename, 'application/pdf' AS \"mimeType\", size FROM tthreads WHERE has_file")
def conversation_attachments(spark: SparkSession, sf: str) -> DataFrame:
    return relations.conversation_attachments(_nested(spark, sf))


@query(f"WITH {e.CONV}, {e.CUSTOMERS} SELECT conv.id, conv.customer_id FROM conv JOIN customers c ON c.id = customer_id JOIN nation n ON n.n_nationkey = c.organization_id WHERE n.n_regionkey = 1")
def org_conversations(spark: SparkSession, sf: str) -> DataFrame:
    orgs = e.table(spark, sf, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("id"))
    return relations.org_conversations(orgs, e.customers(spark, sf), e.flat_conversations(spark, sf)).select("id", "customer_id")


@query(f"WITH {e.CUSTOMERS} SELECT id, email FROM customers WHERE organization_id IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)")
def org_customers(spark: SparkSession, sf: str) -> DataFrame:
    orgs = e.table(spark, sf, "nation").where("n_regionkey = 2").select(F.col("n_nationkey").alias("id"))
    return relations.org_customers(orgs, e.customers(spark, sf)).select("id", "email")


@query(f"WITH {e.AGENTS} SELECT team_id, id, email FROM agents")
def team_members(spark: SparkSession, sf: str) -> DataFrame:
    users = e.agents(spark, sf)
    return relations.team_members(users.drop("team_id"), users.select("team_id", F.col("id").alias("user_id"))).select("team_id", "id", "email")


@query("SELECT mailbox_id, count(*) AS folders FROM (SELECT DISTINCT o_orderkey % 5 AS mailbox_id, o_orderkey % 11 AS id FROM orders) WHERE mailbox_id IN (1, 2) GROUP BY mailbox_id")
def mailbox_folders(spark: SparkSession, sf: str) -> DataFrame:
    conv = e.flat_conversations(spark, sf)
    folders = conv.select("mailbox_id", F.col("folder_id").alias("id")).distinct()
    boxes = conv.where(F.col("mailbox_id").isin(1, 2)).select(F.col("mailbox_id").alias("id"))
    return relations.children(boxes, folders, "id", "mailbox_id").groupBy("mailbox_id").agg(F.count(F.lit(1)).alias("folders"))


@query(f"WITH {e.ARTICLES} SELECT category_id, id FROM (SELECT id, unnest(categories) AS category_id FROM articles) ")
def category_articles(spark: SparkSession, sf: str) -> DataFrame:
    rows = e.articles(spark, sf)
    categories = rows.select(F.explode("categories").alias("id"))
    return relations.category_articles(rows, categories).select("category_id", "id")


@query("SELECT mailbox_id, count(*) AS fields FROM (SELECT DISTINCT o_orderkey % 5 AS mailbox_id, o_orderkey % 4 AS id FROM orders) WHERE mailbox_id IN (0, 3) GROUP BY mailbox_id")
def mailbox_custom_fields(spark: SparkSession, sf: str) -> DataFrame:
    conv = e.flat_conversations(spark, sf)
    fields = conv.select("mailbox_id", F.explode("custom_fields").alias("_f")).select("mailbox_id", F.col("_f.value").alias("id")).distinct()
    boxes = conv.where(F.col("mailbox_id").isin(0, 3)).select(F.col("mailbox_id").alias("id"))
    return relations.children(boxes, fields, "id", "mailbox_id").groupBy("mailbox_id").agg(F.count(F.lit(1)).alias("fields"))


@query(f"WITH {e.ARTICLES} SELECT l_orderkey AS id, l_linenumber AS number, l_partkey AS \"articleId\" FROM lineitem WHERE l_partkey IN (SELECT id FROM articles WHERE status = 'published')")
def article_revisions(spark: SparkSession, sf: str) -> DataFrame:
    revisions = e.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("number"), F.col("l_partkey").alias("articleId"))
    return relations.children(e.articles(spark, sf).where(p.by_article_status("published")), revisions, "id", "articleId").select("id", "number", "articleId")


@query("SELECT page_id AS id, page_id % 7 AS \"siteId\" FROM pages WHERE page_id % 7 IN (SELECT r_regionkey FROM region)")
def site_redirects(spark: SparkSession, sf: str) -> DataFrame:
    redirects = e.table(spark, sf, "pages").select(F.col("page_id").alias("id"), (F.col("page_id") % 7).alias("siteId"))
    return relations.children(e.table(spark, sf, "region"), redirects, "r_regionkey", "siteId").select("id", "siteId")


@query(f"WITH {e.ARTICLES} SELECT a.id, b.name AS related FROM (SELECT id, unnest(related) AS other FROM articles) a JOIN articles b ON b.id = a.other")
def related_articles(spark: SparkSession, sf: str) -> DataFrame:
    rows = e.articles(spark, sf)
    return relations.linked_articles(rows, "related").join(rows.select(F.col("id").alias("other"), F.col("name").alias("related")), "other").select("id", "related")


@query("SELECT page_id, 'https://new.example.com/' || page_id AS redirect FROM pages WHERE page_id % 3 = 0 UNION ALL SELECT page_id, NULL FROM pages WHERE page_id % 3 <> 0")
def find_redirects(spark: SparkSession, sf: str) -> DataFrame:
    rows = e.table(spark, sf, "pages").select("page_id", F.lit("s").alias("site_id"), F.concat("url", F.lit("#"), F.col("page_id").cast("string")).alias("url"))
    known = rows.where("page_id % 3 = 0").select("site_id", F.col("url").alias("url_mapping"), F.concat(F.lit("https://new.example.com/"), F.col("page_id").cast("string")).alias("redirect"))
    return relations.find_redirects(rows, known).select("page_id", "redirect")


@query("SELECT DISTINCT event_type || '-' || op AS command, event_type AS resource, op AS operation, CASE WHEN (event_type = 'click' AND op = 'read') OR event_type = 'view' OR op = 'delete' THEN 'ALLOW' ELSE 'DENY' END AS decision FROM events, (VALUES ('read'), ('write'), ('delete')) o(op)")
def policy_audit(spark: SparkSession, sf: str) -> DataFrame:
    kinds = e.table(spark, sf, "events").select("event_type").distinct()
    asked = kinds.select(F.col("event_type").alias("resource"), F.explode(F.array(*map(F.lit, ("read", "write", "delete")))).alias("operation"))
    return relations.policy_audit(spark, asked.withColumn("command", F.concat_ws("-", "resource", "operation")), "click:read, view:*, *:delete")


@query(f"WITH {e.AGENTS}, {e.CONV}, {e.CUSTOMERS} SELECT conv.id AS conv_id, (c.id IS NOT NULL)::INT + (a.id IS NOT NULL)::INT + 1 AS n, coalesce(c.email, a.email, 'x@example.com') AS first_email FROM conv LEFT JOIN customers c ON c.id = customer_id LEFT JOIN agents a ON a.id = agent_id")
def known_identities(spark: SparkSession, sf: str) -> DataFrame:
    conv = e.with_customers(e.conversations(spark, sf), spark, sf)
    ident = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col(c)["type"].alias("type"), F.col(c)["first"].alias("first"), F.col(c)["last"].alias("last"), F.col(c)["email"].alias("email"), F.lit(None).cast("string").alias("phone")))
    conv = conv.select("id", ident("customer").alias("customer"), ident("assignee").alias("assignee"))
    author = F.struct(F.lit("user").alias("type"), F.lit("Ann").alias("first"), F.lit("Lee").alias("last"), F.lit("x@example.com").alias("email"), F.lit(None).cast("string").alias("phone"))
    threads = e.flat_conversations(spark, sf).select(F.col("id").alias("conv_id"), author.alias("author"))
    return relations.attach_known_identities(threads, conv).select("conv_id", F.size("identities").alias("n"), F.col("identities")[0]["email"].alias("first_email"))


# --- reports, order and pages ---

IN_RANGE = "modified_at >= TIMESTAMP '1996-01-01' AND modified_at < TIMESTAMP '2000-01-01'"


def _report(spark: SparkSession, sf: str, family: str, **kw: object) -> DataFrame:
    return reports.report_rollup(e.flat_conversations(spark, sf), family, F.to_timestamp_ntz(F.lit("1996-01-01 00:00:00")), F.to_timestamp_ntz(F.lit("2000-01-01 00:00:00")), **kw)


for _family, _where in (("conversations", "TRUE"), ("email", "type = 'email'"), ("chats", "type = 'chat'")):
    query(f"WITH {e.CONV} SELECT CAST(date_trunc('month', modified_at) AS TIMESTAMP) AS bucket, count(*) AS n FROM conv WHERE {IN_RANGE} AND {_where} GROUP BY 1", f"report_{_family}")(lambda spark, sf, f=_family: _report(spark, sf, f))


@query(f"WITH {e.CONV} SELECT CAST(date_trunc('year', modified_at) AS TIMESTAMP) AS bucket, tag, count(*) AS n FROM conv WHERE {IN_RANGE} AND mailbox_id = 2 GROUP BY 1, 2")
def report_tags(spark: SparkSession, sf: str) -> DataFrame:
    return _report(spark, sf, "conversations", granularity="year", mailbox=2, view="tags")


REPLIED = "replied AS (SELECT l_orderkey, count(*) FILTER (l_linenumber > 1) AS n_replies FROM lineitem GROUP BY l_orderkey), conv2 AS (SELECT conv.* REPLACE (CASE WHEN id % 13 = 0 THEN 'spam' ELSE status END AS status), n_replies FROM conv LEFT JOIN replied ON l_orderkey = id)"


def _replied(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations with the number of replies, and some of another status."""
    replies = e.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.count_if(F.col("l_linenumber") > 1).alias("n_replies"))
    return e.flat_conversations(spark, sf).withColumn("status", F.when(F.col("id") % 13 == 0, "spam").otherwise(F.col("status"))).join(replies, "id", "left")


def _range(rows: DataFrame, family: str) -> DataFrame:
    return reports.report_rollup(rows, family, F.to_timestamp_ntz(F.lit("1996-01-01 00:00:00")), F.to_timestamp_ntz(F.lit("2000-01-01 00:00:00")))


@query(f"WITH {e.CONV}, {REPLIED} SELECT agent_id, {COUNTS}, CAST(coalesce(sum(n_replies), 0) AS BIGINT) AS replies FROM conv2 WHERE {IN_RANGE} GROUP BY agent_id")
def report_users(spark: SparkSession, sf: str) -> DataFrame:
    return _range(_replied(spark, sf), "users")


@query(f"WITH {e.CONV}, {REPLIED} SELECT count(*) AS n, count(*) FILTER (type = 'email') AS emails, count(*) FILTER (type = 'chat') AS chats, count(DISTINCT customer_id) AS customers, count(DISTINCT agent_id) AS agents, {COUNTS}, CAST(coalesce(sum(n_replies), 0) AS BIGINT) AS replies FROM conv2 WHERE {IN_RANGE}")
def report_company(spark: SparkSession, sf: str) -> DataFrame:
    return _range(_replied(spark, sf), "company")


@query("SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS bucket, round(avg(v), 2) AS avg_minutes, round(quantile_cont(v, 0.5), 2) AS median_minutes, count(v) AS n FROM (SELECT ts, CAST(event_id % 97 AS DOUBLE) AS v FROM events) GROUP BY 1")
def report_productivity(spark: SparkSession, sf: str) -> DataFrame:
    rows = e.table(spark, sf, "events").select(F.col("ts").alias("at"), (F.col("event_id") % 97).cast("double").alias("first_response_minutes"))
    return reports.report_rollup(rows, "productivity", F.to_timestamp_ntz(F.lit("2000-01-01 00:00:00")), F.to_timestamp_ntz(F.lit("2100-01-01 00:00:00")), "day")


@query("SELECT CAST(date_trunc('month', ts) AS TIMESTAMP) AS bucket, event_type, count(*) AS n, round(avg(value), 6) AS mean, TRUE AS median_fits, TRUE AS p90_fits, TRUE AS distinct_fits FROM events GROUP BY ALL")
def report_from_states(spark: SparkSession, sf: str) -> DataFrame:
    """Months rolled up from stored states of days, held against the exact numbers: quantiles by the ranks that they have, distinct users by four standard errors."""
    rows = e.table(spark, sf, "events").select(F.col("ts").alias("at"), "event_type", "user_id", "value")
    months = reports.rolled_up(written(reports.partial_states(rows, "value", "user_id", "event_type")), "month", "event_type")
    month = rows.select(F.date_trunc("month", "at").cast("timestamp_ntz").alias("_bucket"), F.col("event_type").alias("_type"), "value", "user_id")
    both = month.join(written(months), (F.col("_bucket") == F.col("bucket")) & (F.col("_type") == F.col("event_type")))
    share = lambda test: F.count_if(test) / F.count(F.lit(1))
    fits = lambda c, q: ((share(F.col("value") < F.col(c)) <= q + reports.RANK_ERROR) & (share(F.col("value") <= F.col(c)) >= q - reports.RANK_ERROR)).alias(f"{c}_fits")
    exact = F.count_distinct("user_id")
    return both.groupBy("bucket", "event_type", "n", F.round("mean", 6).alias("mean")).agg(fits("median", 0.5), fits("p90", 0.9), (F.abs(F.first("distinct") - exact) <= F.greatest(4 * 0.0163 * exact, F.lit(1))).alias("distinct_fits"))


@query("SELECT event_type AS rating, count(*) AS n FROM events GROUP BY event_type")
def report_ratings(spark: SparkSession, sf: str) -> DataFrame:
    rows = e.table(spark, sf, "events").select(F.col("ts").alias("at"), F.col("event_type").alias("rating"))
    return reports.report_rollup(rows, "ratings", F.to_timestamp_ntz(F.lit("2000-01-01 00:00:00")), F.to_timestamp_ntz(F.lit("2100-01-01 00:00:00")))


@query("SELECT l_partkey AS article_id, CAST(sum(l_linenumber) AS BIGINT) AS views FROM lineitem GROUP BY l_partkey")
def report_docs(spark: SparkSession, sf: str) -> DataFrame:
    rows = e.table(spark, sf, "lineitem").select(F.col("l_shipdate").alias("at"), F.col("l_partkey").alias("article_id"), F.col("l_linenumber").cast("bigint").alias("views"))
    return reports.report_rollup(rows, "docs", F.to_timestamp_ntz(F.lit("1900-01-01 00:00:00")), F.to_timestamp_ntz(F.lit("2100-01-01 00:00:00")))


@query("SELECT CAST(date_trunc('quarter', l_shipdate) AS TIMESTAMP) AS bucket, count(*) AS n FROM lineitem GROUP BY 1")
def report_customers(spark: SparkSession, sf: str) -> DataFrame:
    rows = e.table(spark, sf, "lineitem").select(F.col("l_shipdate").alias("at"))
    return reports.report_rollup(rows, "customers", F.to_timestamp_ntz(F.lit("1900-01-01 00:00:00")), F.to_timestamp_ntz(F.lit("2100-01-01 00:00:00")), "quarter")


@query(f"WITH {e.CONV} SELECT id, subject, modified_at FROM conv ORDER BY modified_at DESC, id LIMIT 25 OFFSET 50")
def sorted_page(spark: SparkSession, sf: str) -> DataFrame:
    return reports.page(reports.sort_by(e.flat_conversations(spark, sf), "modifiedAt"), 3).select("id", "subject", "modified_at")


@query(f"WITH {e.AGENTS}, {e.CONV} SELECT a.id, coalesce(a.first || ' ' || a.last, '(unassigned)') AS agent, coalesce(a.email, '') AS email, {COUNTS} FROM conv JOIN agents a ON a.id = conv.agent_id GROUP BY a.id, a.first, a.last, a.email ORDER BY active DESC, agent LIMIT 10")
def busiest_agents(spark: SparkSession, sf: str) -> DataFrame:
    return briefing.team_overview(e.conversations(spark, sf)).limit(10)


@query(f"WITH {e.ARTICLES} SELECT id, name, views FROM articles ORDER BY views DESC, id LIMIT 20")
def categories_by_popularity(spark: SparkSession, sf: str) -> DataFrame:
    return reports.sort_categories(e.articles(spark, sf), "popularity").limit(20).select("id", "name", "views")


@query(f"WITH {e.ARTICLES} SELECT id, name FROM articles ORDER BY name, id LIMIT 20")
def categories_by_name(spark: SparkSession, sf: str) -> DataFrame:
    return reports.sort_categories(e.articles(spark, sf), "name").limit(20).select("id", "name")


# --- pseudonyms and redaction ---


def _names_sql(names: list[str]) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


def _byte(h: str, at: str) -> str:
    return f"CAST('0x' || substr({h}, {at}, 2) AS INTEGER)"


def hash_sql(data: str, secret: str = "") -> str:
    """SHA-256 in hex; with a secret HMAC, whose two key blocks are constants."""
    if not secret:
        return f"sha256({data})"
    inner, outer = (bytes(b ^ pad for b in secret.encode().ljust(64, b"\0")).hex() for pad in (0x36, 0x5C))
    return f"sha256(from_hex('{outer}') || from_hex(sha256(from_hex('{inner}') || encode({data}))))"


def fake_sql(key: str, secret: str = "") -> tuple[str, str, str]:
    h = hash_sql(f"'person|' || {key}", secret)
    first = f"{_names_sql(pseudonyms.FIRST_NAMES)}[{_byte(h, '1')} % 50 + 1]"
    last = f"{_names_sql(pseudonyms.LAST_NAMES)}[{_byte(h, '3')} % 50 + 1]"
    return first, last, f"lower({first}) || '.' || lower({last}) || '-' || substr({h}, 5, 4) || '@anon.local'"


def phone_sql(secret: str = "") -> str:
    h = hash_sql("'phone|' || regexp_replace(phone, '[^0-9]', '', 'g')", secret)
    return f"(SELECT string_agg(CASE WHEN regexp_full_match(ch, '[0-9]') THEN CAST(CASE WHEN nth = 0 AND ((b + nth) % 256) % 10 = 0 THEN 7 ELSE ((b + nth) % 256) % 10 END AS VARCHAR) ELSE ch END, '' ORDER BY i) FROM (SELECT *, CAST('0x' || substr({h}, CAST(2 * (nth % 32) + 1 AS INTEGER), 2) AS INTEGER) AS b FROM (SELECT i, substr(phone, i, 1) AS ch, length(regexp_replace(substr(phone, 1, i - 1), '[^0-9]', '', 'g')) AS nth FROM (SELECT unnest(range(1, length(phone) + 1))::INTEGER AS i))))"


def _redacted_sql(secret: str = "") -> str:
    first, last, mail = fake_sql("'email:' || lower(email)", secret)
    return f"WITH {e.CUSTOMERS} SELECT id, CASE WHEN id = 0 THEN \"firstName\" ELSE {first} END AS \"firstName\", CASE WHEN id = 0 THEN \"lastName\" ELSE {last} END AS \"lastName\", CASE WHEN id = 0 THEN email ELSE {mail} END AS email, CASE WHEN id = 0 THEN phone ELSE {phone_sql(secret)} END AS phone FROM customers"


@query(_redacted_sql())
def redact_customers(spark: SparkSession, sf: str) -> DataFrame:
    return redaction.redact_customer(e.customers(spark, sf), "all").select("id", "firstName", "lastName", "email", "phone")


@query(f"WITH {e.AGENTS} SELECT id, first AS \"firstName\", last AS \"lastName\", email FROM agents")
def redact_users_in_customer_mode(spark: SparkSession, sf: str) -> DataFrame:
    users = e.agents(spark, sf).select("id", F.col("first").alias("firstName"), F.col("last").alias("lastName"), "email")
    return redaction.redact_customer(users, "customers", kind="user")


@query("SELECT c_custkey AS id, '[[ssn_' || substr(sha256('ssn|' || lower(c_name)), 1, 4) || ']]' AS token, trim(regexp_replace(lower(c_name), '[^a-z0-9]+', '.', 'g'), '.') AS slug, sha256(c_name) AS hash FROM customer")
def tokens(spark: SparkSession, sf: str) -> DataFrame:
    c = e.table(spark, sf, "customer")
    return c.select(F.col("c_custkey").alias("id"), pseudonyms.token("ssn", "c_name").alias("token"), pseudonyms.slug("c_name").alias("slug"), pseudonyms.hash_hex("c_name").alias("hash"))


@query(f"WITH {e.CUSTOMERS} SELECT id, \"firstName\", \"lastName\", email, phone FROM customers")
def unredacted_customers(spark: SparkSession, sf: str) -> DataFrame:
    """The policy allows unredacted output, and it is asked for."""
    return redaction.redact_customer(e.customers(spark, sf), redaction.effective_mode("all", True, True)).select("id", "firstName", "lastName", "email", "phone")


@query(_redacted_sql("a secret"))
def keyed_pseudonyms(spark: SparkSession, sf: str) -> DataFrame:
    """With a secret: HMAC instead of the plain hash."""
    return redaction.redact_customer(e.customers(spark, sf), "all", secret="a secret").select("id", "firstName", "lastName", "email", "phone")


def _rules_sql(table: str, key: str, column: str) -> str:
    """The chain of rules, a common table expression for each."""
    steps = [f"r0 AS (SELECT {key}, {column} AS t, regexp_matches({column}, '{patterns.SSN_CONTEXT}') AS said FROM {table})"]
    for i, (kind, pattern) in enumerate(patterns.RULES):
        quoted = pattern.replace("'", "''")
        token = lambda m, kind=kind: f"'[[{kind}_' || substr(sha256('{kind}|' || lower(trim({m}))), 1, 4) || ']]'"
        put = token("m")
        if kind == "ssn":
            digits = "regexp_replace(m, '[^0-9]', '', 'g')"
            put = f"CASE WHEN regexp_matches(m, '[- ]') OR (said AND length({digits}) = 9) THEN {token(digits)} ELSE m END"
        parts = f"list_zip(regexp_split_to_array(t, '{quoted}'), list_transform(regexp_extract_all(t, '{quoted}'), lambda m: {put}))"
        steps.append(f"r{i + 1} AS MATERIALIZED (SELECT {key}, CASE WHEN regexp_matches(t, '{quoted}') THEN array_to_string(list_transform({parts}, lambda z: z[1] || coalesce(z[2], '')), '') ELSE t END AS t, said FROM r{i})")
    return f"WITH {', '.join(steps)} SELECT {key}, t AS {column} FROM r{len(patterns.RULES)}"


@query(_rules_sql("documents", "doc_id", "text"))
def redact_rules(spark: SparkSession, sf: str) -> DataFrame:
    return patterns.apply_rules(dealt(e.table(spark, sf, "documents").select("doc_id", "text")), "text")


def _rule_hits_sql() -> str:
    return "SELECT doc_id, " + ", ".join(f"CAST(len(regexp_extract_all(text, '{r.replace(chr(39), chr(39) * 2)}')) AS INTEGER) AS rule_{i}" for i, (_, r) in enumerate(patterns.RULES)) + " FROM documents"


@query(_rule_hits_sql())
def rule_hits(spark: SparkSession, sf: str) -> DataFrame:
    return patterns.count_hits(dealt(e.table(spark, sf, "documents").select("doc_id", "text")), "text")


def _word_sql(text: str, literal: str, put: str, word: bool = True) -> str:
    """SQL that replaces a literal, given by an expression, in any case."""
    edge = "\\b" if word else ""
    return f"regexp_replace({text}, '(?i){edge}' || regexp_replace({literal}, '([\\\\^$.|?*+()\\[\\]{{}}])', '\\\\\\1', 'g') || '{edge}', {put}, 'g')"


def _known_sql(text: str, key: str, first: str | None = None, last: str | None = None, email: str | None = None, phone: str | None = None) -> str:
    """SQL of what one known person loses in a text; expressions of what is known of them."""
    fake = fake_sql(key)
    mark = f"'[[person_' || substr(sha256('person|' || {key}), 1, 4) || ']]'"
    for literal, put, word in ((email, mark, False), (phone, mark, False), (first and f"{first} || ' ' || {last}", f"{fake[0]} || ' ' || {fake[1]}", True), (first, fake[0], True), (last, fake[1], True), (email and f"split_part({email}, '@', 1)", fake[0], True)):
        if literal:
            text = _word_sql(text, literal, put, word)
    return text


def found_sql(table: str, key: str, column: str, spoken: str = e.SPOKEN_NAMES) -> str:
    """Common table expressions up to ``kept``: the spans (s, e, t) of spoken names in each text, from the left, the longest first."""
    word = names.WORD.replace("'", "''")
    return rf"""{spoken}, cut AS (SELECT {key}, regexp_split_to_array({column}, '{word}') AS gaps, regexp_extract_all({column}, '{word}') AS found FROM {table}),
w0 AS (SELECT {key}, unnest(found) AS w, unnest(gaps[1 : len(found)]) AS g, generate_subscripts(found, 1) AS i FROM cut),
w AS (SELECT *, CAST(sum(length(g) + length(w)) OVER (PARTITION BY {key} ORDER BY i) AS INTEGER) AS e, regexp_full_match(g, '\s+') AS glued FROM w0),
near AS (SELECT {key}, e - length(w) AS s, e, w, lead(w) OVER o AS w2, lead(e) OVER o AS e2, lead(glued) OVER o AS g2, lead(w, 2) OVER o AS w3, lead(e, 2) OVER o AS e3, lead(glued, 2) OVER o AS g3 FROM w WINDOW o AS (PARTITION BY {key} ORDER BY i)),
tried AS (SELECT {key}, s, e2 AS e, w || ' ' || w2 AS t FROM near WHERE g2 UNION ALL SELECT {key}, s, e3, w || ' ' || w2 || ' ' || w3 FROM near WHERE g2 AND g3),
hits AS (SELECT {key}, CAST(s AS INTEGER) AS s, e, t FROM tried JOIN spoken ON name = t),
kept AS (SELECT {key}, list_reduce(list_prepend({{'s': -1, 'e': -1, 'out': []}}, list({{'s': s, 'e': e, 'out': [{{'s': s, 'e': e, 't': t}}]}} ORDER BY s, e DESC)), lambda a, b: CASE WHEN b.s >= a.e THEN {{'s': b.s, 'e': b.e, 'out': list_concat(a.out, b.out)}} ELSE a END).out AS spans FROM hits GROUP BY {key})"""


def _messages_sql() -> str:
    """The customer's names, then those found in the text, then the rules; the assignee's names are protected."""
    key = "'email:' || lower(c.email)"
    long = lambda c: f"CASE WHEN octet_length(encode({c})) >= 3 THEN {c} END"
    fake, mark = fake_sql(key), f"'[[person_' || substr(sha256('person|' || {key}), 1, 4) || ']]'"
    t = "text"
    for literal, put, word in (("c.email", mark, False), ("c.first || ' ' || c.last", f"{fake[0]} || ' ' || {fake[1]}", True), (long("c.first"), fake[0], True), (long("c.last"), fake[1], True), ("split_part(c.email, '@', 1)", fake[0], True)):
        t = f"coalesce({_word_sql(t, literal, put, word)}, {t})"
    put = f"list_filter([{fake[0]} || ' ' || {fake[1]}, CASE WHEN octet_length(encode(c.first)) >= 3 THEN {fake[0]} END, CASE WHEN octet_length(encode(c.last)) >= 3 THEN {fake[1]} END], lambda x: x IS NOT NULL)"
    kept = f"list_filter([lower(a.first || ' ' || a.last), lower({long('a.first')}), lower({long('a.last')}), split_part(a.email, '@', 1)], lambda x: x IS NOT NULL)"
    name = fake_sql("'name:' || lower(b.t)")
    skip = "list_has_any(list_prepend(b.t, regexp_split_to_array(b.t, '\\s+')), a.put) OR list_has_any(list_transform(list_prepend(b.t, regexp_split_to_array(b.t, '\\s+')), lambda x: lower(x)), a.keep)"
    swapped = _word_sql("a.t", "b.t", f"{name[0]} || ' ' || {name[1]}")
    step = f"CASE WHEN {skip} THEN a ELSE {{'t': {swapped}, 'put': list_append(a.put, {name[0]} || ' ' || {name[1]}), 'keep': a.keep}} END"
    none = "CAST([] AS VARCHAR[])"
    said = f"list_transform(list_distinct_in_order, lambda x: {{'t': x, 'put': {none}, 'keep': {none}}})"
    return _rules_sql(f"""(WITH {found_sql("conversations", "conv_id, turn", "text", e.TURN_NAMES)},
named AS (SELECT conv_id, turn, list_transform(list_filter(spans, lambda x, i: NOT list_contains(list_transform(spans[1 : i - 1], lambda y: y.t), x.t)), lambda x: x.t) AS list_distinct_in_order FROM kept),
known AS (SELECT m.conv_id, m.turn, {t} AS t, CASE WHEN c.conv_id IS NULL THEN {none} ELSE {put} END AS put, CASE WHEN a.conv_id IS NULL THEN {none} ELSE {kept} END AS keep
  FROM conversations m LEFT JOIN openers c ON c.conv_id = m.conv_id LEFT JOIN openers a ON a.conv_id = m.conv_id + 1)
SELECT k.conv_id, k.turn, CASE WHEN list_distinct_in_order IS NULL THEN k.t ELSE list_reduce(list_prepend({{'t': k.t, 'put': put, 'keep': keep}}, {said}), lambda a, b: {step}).t END AS text
FROM known k LEFT JOIN named n ON n.conv_id = k.conv_id AND n.turn = k.turn)""", "conv_id, turn", "text")


def _opened_conversations(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations with the person that they open with as customer, and that of the next one as assignee."""
    people = e.openers(spark, sf)
    person = lambda kind: F.struct(F.lit(kind).alias("type"), "first", "last", "email", F.lit(None).cast("string").alias("phone"))
    conv = e.table(spark, sf, "conversations").select(F.col("conv_id").alias("id")).distinct()
    customers = people.select(F.col("conv_id").alias("id"), person("customer").alias("customer"))
    agents = people.select((F.col("conv_id") - 1).alias("id"), person("user").alias("assignee"))
    return conv.join(customers, "id", "left").join(agents, "id", "left")


@query(_messages_sql())
def redact_messages(spark: SparkSession, sf: str) -> DataFrame:
    """Turns of all conversations: persons of each conversation, names of a table found in the texts, then the rules, in one job."""
    threads = e.table(spark, sf, "conversations").select("conv_id", "turn", "text", F.lit(None).cast(redaction.IDENTITY).alias("author"))
    return redaction.redact_threads(threads, _opened_conversations(spark, sf), e.turn_names(spark, sf), "customers", "text", ("conv_id", "turn")).select("conv_id", "turn", "text")


@query(_rules_sql("conversations", "conv_id, turn", "text"))
def redact_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Raw sources: no known identities, and a detector that finds no names, so the rules alone."""
    rows = e.table(spark, sf, "conversations").select("conv_id", "turn", "text", F.array().cast("array<string>").alias("names"))
    return redaction.redact_source(rows, "text", "all", "names").select("conv_id", "turn", "text")


@query("SELECT conv_id, turn, role, CASE WHEN text = '' THEN text ELSE '[redacted: no name detector is set up]' END AS text FROM conversations")
def redact_without_detector(spark: SparkSession, sf: str) -> DataFrame:
    return redaction.redact_text(e.table(spark, sf, "conversations"), "text", "all")


_FF, _FL, _FM = fake_sql("'email:' || lower(email)")


@query(f"WITH {e.AGENTS} SELECT id, {_FF} AS first, {_FM} AS email, {fake_sql(chr(39) + 'email:cc@example.com' + chr(39))[2]} AS cc FROM agents WHERE id <> 0 UNION ALL SELECT id, first, email, {fake_sql(chr(39) + 'email:cc@example.com' + chr(39))[2]} FROM agents WHERE id = 0")
def redact_records(spark: SparkSession, sf: str) -> DataFrame:
    person = F.struct("id", "type", "first", "last", "email").alias("assignee")
    rows = e.agents(spark, sf).select("id", person, F.array(F.lit("cc@example.com")).alias("cc"))
    return redaction.redact_struct(rows, "all").select("id", "assignee.first", "assignee.email", F.col("cc")[0].alias("cc"))


@query(f"WITH {e.CUSTOMERS} SELECT id, {_FF} AS contact, {_FM} AS contact_email, \"firstName\" AS owner, {_FF} AS other, '{redaction.NOTICE}' AS preview, background AS note FROM customers WHERE id <> 0 UNION ALL SELECT id, \"firstName\", email, \"firstName\", \"firstName\", '{redaction.NOTICE}', background FROM customers WHERE id = 0")
def redact_typed_records(spark: SparkSession, sf: str) -> DataFrame:
    """In mode ``customers``: persons typed by what their field is called, by their own type over that, and text fields."""
    c = e.customers(spark, sf)
    person = lambda *more: F.struct("id", F.col("firstName").alias("first"), F.col("lastName").alias("last"), "email", *more)
    rows = c.select("id", person().alias("customerContact"), person().alias("owner"), person(F.lit(" Customer ").alias("type")).alias("assignedTo"), F.col("email").alias("preview"), F.col("background").alias("note"))
    out = redaction.redact_struct(rows, "customers")
    return out.select("id", F.col("customerContact.first").alias("contact"), F.col("customerContact.email").alias("contact_email"), F.col("owner.first").alias("owner"), F.col("assignedTo.first").alias("other"), "preview", "note")


def _nested_sql() -> str:
    """Texts one by one: which persons each knows, then the rules."""
    who = "'email:' || lower(email)"
    known = lambda t: _known_sql(t, who, '"firstName"', '"lastName"', "email")
    phone = "'phone:' || regexp_replace(phone, '[^0-9]', '', 'g')"
    real = lambda t: f"CASE WHEN id = 0 THEN {t} ELSE {known(t)} END"
    texts = [("note", real("note")), ("ask", real("ask")), ("contact", _known_sql(real("contact"), phone, phone="phone")), ("beside", "beside")]
    rows = " UNION ALL ".join(f"SELECT id, '{k}' AS k, {t} AS t0 FROM said" for k, t in texts)
    said = f"""said AS (SELECT *, "firstName" || ' ' || "lastName" || ' rang about ' || background AS note, 'CUSTOMER wrote: mail ' || email AS ask, 'ring ' || phone || ' for "' || "lastName" || '"' AS contact, 'seen: ' || "lastName" || ' in ' || background AS beside FROM customers)"""
    chain = _rules_sql(f"(WITH {e.CUSTOMERS}, {said} SELECT id, k, t0 AS text FROM ({rows}))", "id, k", "text")
    return f"SELECT id, max(text) FILTER (k = 'note') AS note, max(text) FILTER (k = 'ask') AS ask, max(text) FILTER (k = 'contact') AS contact, max(text) FILTER (k = 'beside') AS beside FROM ({chain}) GROUP BY id"


def _nested_records(spark: SparkSession, sf: str) -> DataFrame:
    """Customers with notes two levels below them, a contact known by phone alone among those, and a text beside them."""
    c = e.customers(spark, sf)
    person = F.concat("firstName", F.lit(" "), "lastName")
    notes = F.array(F.struct(F.concat(person, F.lit(" rang about "), "background").alias("text")), F.struct(F.concat(F.lit("CUSTOMER wrote: mail "), "email").alias("text")))
    contact = F.struct(F.col("phone"), F.struct(F.concat(F.lit("ring "), "phone", F.lit(' for "'), "lastName", F.lit('"')).alias("message")).alias("last_call"))
    customer = F.struct("id", "type", F.col("firstName").alias("first"), F.col("lastName").alias("last"), "email", F.struct(notes.alias("entries")).alias("history"), contact.alias("line"))
    return c.select("id", customer.alias("primaryCustomer"), F.concat(F.lit("seen: "), "lastName", F.lit(" in "), "background").alias("preview"))


def _no_names(texts: Column) -> Column:
    return F.transform(texts, lambda t: F.array().cast("array<string>"))


@query(_nested_sql())
def redact_nested_records(spark: SparkSession, sf: str) -> DataFrame:
    """Texts lose the names of the persons above them at any depth, and none of those beside them; the rules run on all."""
    out = redaction.redact_struct(_nested_records(spark, sf), "customers", detect=_no_names)
    entries = F.col("primaryCustomer.history.entries")
    return out.select("id", entries[0]["text"].alias("note"), entries[1]["text"].alias("ask"), F.col("primaryCustomer.line.last_call.message").alias("contact"), F.col("preview").alias("beside"))


@query(_nested_sql().replace("max(text) FILTER (k = 'contact') AS contact", "CASE WHEN id % 3 <> 0 THEN max(text) FILTER (k = 'contact') END AS contact"))
def redact_raw_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The same records as JSON texts, some without a part of them: the schema is found in the documents."""
    rows = _nested_records(spark, sf)
    customer = F.col("primaryCustomer")
    rows = rows.withColumn("primaryCustomer", customer.withField("line", F.when(F.col("id") % 3 != 0, customer["line"])))
    raw = rows.select("id", F.to_json(F.struct(*rows.columns)).alias("raw"))
    out = redaction.redact_json(raw, "raw", "customers", detect=_no_names)
    said = {"note": "primaryCustomer.history.entries[0].text", "ask": "primaryCustomer.history.entries[1].text", "contact": "primaryCustomer.line.last_call.message", "beside": "preview"}
    return out.select("id", *[F.get_json_object("raw", f"$.{path}").alias(name) for name, path in said.items()])


# --- names ---


@query("""SELECT vec_id, k, ['O','B-PER','I-PER','B-LOC','I-LOC','B-ORG','I-ORG'][list_position(s, list_max(s))] AS label, round(1 / list_sum(list_transform(s, lambda v: exp(v::DOUBLE - list_max(s)::DOUBLE))), 6) AS confidence
FROM (SELECT vec_id, k, embedding[7 * k + 1 : 7 * k + 7] AS s FROM (SELECT *, unnest(range(0, len(embedding) // 7)) AS k FROM embeddings))""")
def decode_logits(spark: SparkSession, sf: str) -> DataFrame:
    """Each vector as the scores of its tokens, seven labels a token; labels by a map of ids."""
    labels = names.label_map(dict(enumerate(names.LABELS)))
    v = e.table(spark, sf, "embeddings")
    v = v.select("vec_id", "embedding", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.size("embedding") / 7) - 1)).alias("k"))
    v = v.select("vec_id", "k", names.decode_logits(F.slice("embedding", (7 * F.col("k") + 1).cast("int"), F.lit(7)), labels).alias("d"))
    return v.select("vec_id", "k", "d.label", F.round("d.confidence", 6).alias("confidence"))


TOKENS = "tokens AS (SELECT event_id // 50 AS doc_id, user_id % 2 AS chunk_id, event_id AS tok_idx, CASE event_type WHEN 'click' THEN 'B-PER' WHEN 'view' THEN 'I-PER' WHEN 'error' THEN 'I-PER' ELSE 'O' END AS label, 0.5 + (event_id % 50) / 128.0 AS conf, CASE WHEN event_id % 50 = 0 THEN 0 ELSE event_id % 50 * 5 END AS s, CASE WHEN event_id % 50 = 0 THEN 0 ELSE event_id % 50 * 5 + 4 END AS f FROM events)"


@query(f"""WITH {TOKENS}, runs AS (SELECT *, sum(CASE WHEN (s = 0 AND f = 0) OR label <> 'I-PER' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, chunk_id ORDER BY tok_idx) AS run FROM tokens),
spans AS (SELECT doc_id, chunk_id, run, min_by(label, tok_idx) AS head, min(s) AS start, max(f) AS "end", round(avg(conf), 6) AS score FROM runs WHERE label IN ('B-PER', 'I-PER') AND NOT (s = 0 AND f = 0) GROUP BY ALL)
SELECT doc_id, chunk_id, CAST(start AS INTEGER) AS start, CAST("end" AS INTEGER) AS "end", score FROM spans WHERE head = 'B-PER' AND score >= 0.7""")
def merge_spans(spark: SparkSession, sf: str) -> DataFrame:
    v, at = e.table(spark, sf, "events"), F.col("event_id") % 50
    label = F.when(F.col("event_type") == "click", "B-PER").when(F.col("event_type").isin("view", "error"), "I-PER").otherwise("O")
    rows = v.select(F.floor(F.col("event_id") / 50).alias("doc_id"), (F.col("user_id") % 2).alias("chunk_id"), F.col("event_id").alias("tok_idx"), label.alias("label"), (0.5 + at / 128).alias("conf"), (at * 5).cast("int").alias("start"), F.when(at == 0, 0).otherwise(at * 5 + 4).cast("int").alias("end"))
    return names.merge_person_spans(rows).withColumn("score", F.round("score", 6))


_END = "length(regexp_extract({w}, '(?s)^(.*){c}', 1))"
_CUT = "CASE " + " ".join(f"WHEN {_END.format(w='w', c=c)} > 0 THEN {_END.format(w='w', c=c)} + 1" for c in ("\\n", "[ \\t]", "[" + re.sub(r"([\]\[\\^-])", r"\\\1", names._SPECIAL).replace("'", "''") + "]")) + " ELSE 1200 END"


@query(f"""WITH RECURSIVE chunks AS (SELECT doc_id, text, 0 AS chunk_id, 0 AS pos, left(text, 1200) AS w, length(text) AS n FROM documents
UNION ALL SELECT doc_id, text, chunk_id + 1, pos + c, substr(text, pos + c + 1, 1200), n FROM (SELECT *, {_CUT} AS c FROM chunks WHERE n - pos > 1200))
SELECT doc_id, CAST(chunk_id AS INTEGER) AS chunk_id, CASE WHEN n - pos > 1200 THEN left(w, CAST({_CUT} AS BIGINT)) ELSE w END AS text, CAST(pos AS INTEGER) AS \"offset\" FROM chunks""")
def chunk_texts(spark: SparkSession, sf: str) -> DataFrame:
    return names.chunk_text(e.table(spark, sf, "documents"))


@query(f"WITH {found_sql('documents', 'doc_id', 'text')} SELECT DISTINCT doc_id, unnest(list_transform(spans, lambda x: x.t)) AS text FROM kept")
def gazetteer_names(spark: SparkSession, sf: str) -> DataFrame:
    return names.gazetteer_names(e.table(spark, sf, "documents"), e.spoken_names(spark, sf))


@query(f"WITH {found_sql('conversations', 'conv_id, turn', 'text', e.TURN_NAMES)} SELECT conv_id, turn, x.s AS start, x.e AS \"end\", x.t AS text FROM (SELECT conv_id, turn, unnest(spans) AS x FROM kept)")
def names_in_turns(spark: SparkSession, sf: str) -> DataFrame:
    """Names of a table in all turns: a hash join of the words of names and texts."""
    return names.names_in_texts(e.table(spark, sf, "conversations"), e.turn_names(spark, sf), ("conv_id", "turn"))


@query(f"""WITH {found_sql('documents', 'doc_id', 'text')} SELECT doc_id, x.s AS start, x.e AS "end", substr(text, x.s + 1, x.e - x.s) AS text, CAST(1.0 AS DOUBLE) AS score FROM (SELECT doc_id, unnest(spans) AS x FROM kept) JOIN documents USING (doc_id)""")
def detect_names(spark: SparkSession, sf: str) -> DataFrame:
    """The same names by a trie that goes over chunks of the texts as a stream; names over an edge are found once."""
    return names.detect_names(e.table(spark, sf, "documents"), names.trie_detector(e.spoken_names(spark, sf)))


# --- search ---


@query(rf"""WITH words AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS term FROM documents),
tf AS (SELECT id, term, count(*) AS tf FROM words GROUP BY ALL), sizes AS (SELECT id, sum(tf) AS len FROM tf GROUP BY id),
stats AS (SELECT count(*) AS n, avg(len) AS mean FROM sizes), idf AS (SELECT term, ln(1 + ((SELECT n FROM stats) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf GROUP BY term),
opening AS (SELECT item_id AS q, regexp_extract(text, '{e._TWO}', 1) AS first, regexp_extract(text, '{e._TWO}', 2) AS last FROM benchmark),
asked AS (SELECT q, lower(first) AS term, CASE WHEN q % 2 = 0 THEN 'must' ELSE 'should' END AS need FROM opening WHERE first <> '' UNION ALL SELECT q, lower(last), 'should' FROM opening WHERE first <> '' UNION ALL SELECT q - 1, lower(last), 'not' FROM opening WHERE first <> '' AND q % 5 = 1),
terms AS (SELECT q, term, min(CASE need WHEN 'not' THEN 0 WHEN 'must' THEN 1 ELSE 2 END) AS need FROM asked GROUP BY q, term), wanted AS (SELECT q, count(*) FILTER (need = 1) AS n FROM terms GROUP BY q),
hits AS (SELECT q, id, need, idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean)) AS score FROM terms JOIN tf USING (term) JOIN sizes USING (id) JOIN idf USING (term), stats),
sums AS (SELECT q, id, sum(score) AS score FROM hits JOIN wanted USING (q) GROUP BY q, id, n HAVING count(*) FILTER (need = 0) = 0 AND count(*) FILTER (need = 1) = n),
ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, id) AS r FROM sums)
SELECT q AS query_id, id, CAST(r AS INTEGER) AS rank, round(score, 6) AS score FROM ranked WHERE r <= 10""")
def ranked_search(spark: SparkSession, sf: str) -> DataFrame:
    """The ten best documents for the opening words of each benchmark text, for some without those that have a word of the next one's."""
    index = search.build_index(e.table(spark, sf, "documents"), "doc_id", "text")
    first, last = (F.regexp_extract("text", e._TWO, i) for i in (1, 2))
    o, q = e.table(spark, sf, "benchmark").select("item_id", first.alias("first"), last.alias("last")).where("first <> ''"), F.col("item_id")
    asked = o.select(q.alias("query_id"), F.col("first").alias("term"), F.when(q % 2 == 0, "must").otherwise("should").alias("need")).union(o.select(q, "last", F.lit("should"))).union(o.where(q % 5 == 1).select(q - 1, "last", F.lit("not")))
    return search.search(index, asked, 10)


# --- changes ---


_LOG = "log AS (SELECT l_orderkey AS id, CASE l_returnflag WHEN 'R' THEN 'closed' WHEN 'A' THEN 'pending' ELSE 'active' END AS status, l_shipdate AS ts, l_linenumber AS seq FROM lineitem)"
_HISTORY = f"""{_LOG}, fresh AS (SELECT * FROM (SELECT *, lag(status) OVER (PARTITION BY id ORDER BY ts NULLS FIRST, seq NULLS FIRST, status NULLS FIRST) AS before FROM log) WHERE before IS DISTINCT FROM status),
history AS (SELECT * FROM (SELECT id, status, ts AS start, lead(ts) OVER (PARTITION BY id ORDER BY ts NULLS FIRST, seq NULLS FIRST, status NULLS FIRST) AS "end" FROM fresh) WHERE "end" IS NULL OR start < "end")"""


def _log(spark: SparkSession, sf: str) -> DataFrame:
    line = e.table(spark, sf, "lineitem")
    status = F.when(F.col("l_returnflag") == "R", "closed").when(F.col("l_returnflag") == "A", "pending").otherwise("active")
    return line.select(F.col("l_orderkey").alias("id"), status.alias("status"), F.col("l_shipdate").alias("at"), F.col("l_linenumber").alias("seq"))


@query(f"WITH {_HISTORY} SELECT id, status, start, \"end\" FROM history")
def status_history(spark: SparkSession, sf: str) -> DataFrame:
    return changes.status_history(_log(spark, sf))


@query(f"""WITH {_HISTORY}, moves AS (SELECT CAST(start AS DATE) AS day, 1 AS up FROM history WHERE status <> 'closed' UNION ALL SELECT CAST("end" AS DATE), -1 FROM history WHERE status <> 'closed' AND "end" IS NOT NULL),
days AS (SELECT CAST(unnest(generate_series((SELECT min(day) FROM moves), (SELECT max(day) FROM moves), INTERVAL 1 DAY)) AS DATE) AS day)
SELECT days.day, count(*) FILTER (up = 1) AS opened, count(*) FILTER (up = -1) AS closed, CAST(sum(coalesce(sum(up), 0)) OVER (ORDER BY days.day) AS BIGINT) AS open FROM days LEFT JOIN moves ON moves.day = days.day GROUP BY days.day""")
def open_by_day(spark: SparkSession, sf: str) -> DataFrame:
    return changes.open_by_day(changes.status_history(_log(spark, sf)))


@query("""WITH RECURSIVE r AS (SELECT page_id % 3 AS site, page_id AS url, CASE WHEN page_id % 89 < 3 THEN page_id - 30 ELSE page_id + 3 END AS "to" FROM pages WHERE page_id % 97 >= 3),
walk AS (SELECT site, url AS start, [url] AS seen, "to" AS cur FROM r UNION ALL SELECT w.site, start, list_append(seen, r.url), r."to" FROM walk w JOIN r ON r.site = w.site AND r.url = w.cur WHERE NOT list_contains(seen, w.cur)),
ends AS (SELECT w.site, start, cur, len(seen) AS hops FROM walk w WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.site = w.site AND r.url = w.cur))
SELECT r.site AS site_id, 'p' || url AS url_mapping, 'p' || cur AS target, CAST(hops AS BIGINT) AS hops, hops IS NULL AS looped FROM r LEFT JOIN ends ON ends.site = r.site AND start = url""")
def resolve_redirects(spark: SparkSession, sf: str) -> DataFrame:
    """Chains over the pages of each site, some of which run into loops."""
    pid = F.col("page_id")
    rows = e.table(spark, sf, "pages").where(pid % 97 >= 3)
    to = F.when(pid % 89 < 3, pid - 30).otherwise(pid + 3)
    named = lambda c: F.concat(F.lit("p"), c.cast("string"))
    return relations.resolve_redirects(rows.select((pid % 3).alias("site_id"), named(pid).alias("url_mapping"), named(to).alias("redirect")))



@query(f"""WITH {e.CONV}, patches AS (SELECT l_orderkey AS id, CASE l_linenumber % 3 WHEN 0 THEN '/subject' WHEN 1 THEN '/status' ELSE '/other' END AS path, CAST(l_partkey AS VARCHAR) AS value, CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey AS seq FROM lineitem),
last AS (SELECT id, max_by(value, seq) FILTER (path = '/subject') AS subject, max_by(value, seq) FILTER (path = '/status') AS status FROM patches GROUP BY id)
SELECT conv.id, coalesce(last.subject, conv.subject) AS subject, coalesce(last.status, conv.status) AS status FROM conv LEFT JOIN last ON last.id = conv.id""")
def apply_patches(spark: SparkSession, sf: str) -> DataFrame:
    line = e.table(spark, sf, "lineitem")
    number = F.col("l_linenumber") % 3
    patches = line.select(F.col("l_orderkey").alias("id"), F.lit("replace").alias("op"), F.when(number == 0, "/subject").when(number == 1, "/status").otherwise("/other").alias("path"), F.col("l_partkey").cast("string").alias("value"), (F.col("l_linenumber") * F.lit(1_000_000_000).cast("bigint") + F.col("l_partkey")).alias("seq"))
    return changes.apply_patches(e.flat_conversations(spark, sf).select("id", "subject", "status"), patches)


@query("SELECT o_orderkey AS id, CASE WHEN n > 0 THEN v ELSE o_orderpriority END AS tag FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, arg_max_null(CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag END, CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey * 10 + ascii(l_returnflag) % 10) AS v FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey")
def replace_attributes(spark: SparkSession, sf: str) -> DataFrame:
    snapshot = e.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("tag"))
    new = e.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_returnflag")).alias("value"), (F.col("l_linenumber") * F.lit(1_000_000_000).cast("bigint") + F.col("l_partkey") * 10 + F.ascii("l_returnflag") % 10).alias("seq"))
    return changes.replace_attributes(snapshot, new, "tag")


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'changed' ELSE c_name END AS name FROM customer UNION ALL SELECT c_custkey + 1000000000, 'new' FROM customer WHERE c_custkey % 5 = 0")
def upsert_customers(spark: SparkSession, sf: str) -> DataFrame:
    c = e.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    changed = c.where("id % 3 = 0").select("id", F.lit("changed").alias("name"), F.lit(2).alias("seq")).union(c.where("id % 3 = 0").select("id", F.lit("old").alias("name"), F.lit(1).alias("seq")))
    return changes.upsert(c, changed.union(c.where("id % 5 = 0").select(F.col("id") + 1_000_000_000, F.lit("new"), F.lit(1))))


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 3)")
def delete_rows(spark: SparkSession, sf: str) -> DataFrame:
    snapshot = e.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    return changes.delete(snapshot, e.table(spark, sf, "lineitem").where("l_linenumber = 3").select(F.col("l_orderkey").alias("id")))


@query(f"WITH {e.CUSTOMERS}, patches AS (SELECT o_custkey AS id, o_orderkey AS seq, o_orderkey % 4 AS k, o_orderpriority || o_orderkey AS value FROM orders), per AS (SELECT id, max_by(value, seq) FILTER (k = 0) AS first, max_by(value, seq) FILTER (k = 1) AS last, array_to_string(list(value ORDER BY seq) FILTER (k = 2), ';') AS more FROM patches GROUP BY id) SELECT customers.id, coalesce(first, \"firstName\") AS \"firstName\", coalesce(last, \"lastName\") AS \"lastName\", phone || coalesce(';' || more, '') AS phones FROM customers LEFT JOIN per ON per.id = customers.id")
def apply_customer_patches(spark: SparkSession, sf: str) -> DataFrame:
    """Names are replaced by the last patch, phones are added in order, other paths mean nothing here."""
    o, at = e.table(spark, sf, "orders"), F.col("o_orderkey") % 4
    path = F.when(at == 0, "/firstName").when(at == 1, "/lastName").when(at == 2, "/phones").otherwise("/body")
    patches = o.select(F.col("o_custkey").alias("id"), F.when(at == 2, "add").otherwise("replace").alias("op"), path.alias("path"), F.concat("o_orderpriority", F.col("o_orderkey").cast("string")).alias("value"), F.col("o_orderkey").alias("seq"))
    snapshot = e.customers(spark, sf).select("id", "firstName", "lastName", F.array("phone").alias("phones"))
    return changes.apply_patches(snapshot, patches).withColumn("phones", F.array_join("phones", ";"))


@query("SELECT s_suppkey AS id, CASE s_nationkey % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'inactive' ELSE 'draft' END AS status FROM supplier")
def apply_workflow_patches(spark: SparkSession, sf: str) -> DataFrame:
    """Statuses of workflows, checked before they are applied."""
    s, at = e.table(spark, sf, "supplier"), F.col("s_nationkey") % 3
    patches = changes.check_workflow_statuses(s.where(at < 2).select(F.col("s_suppkey").alias("id"), F.lit("replace").alias("op"), F.lit("/status").alias("path"), F.when(at == 0, "active").otherwise("inactive").alias("value"), F.lit(1).alias("seq")))
    return changes.apply_patches(s.select(F.col("s_suppkey").alias("id"), F.lit("draft").alias("status")), patches)


@query("SELECT conv_id, turn, coalesce(CASE WHEN turn % 3 = 0 THEN upper(role) END, text) AS body, CASE WHEN turn % 3 = 1 THEN 'hidden' ELSE 'active' END AS status FROM conversations")
def apply_thread_patches(spark: SparkSession, sf: str) -> DataFrame:
    """Bodies and statuses of threads, whose ids are pairs."""
    t = e.table(spark, sf, "conversations").withColumn("id", F.struct("conv_id", "turn"))
    at = F.col("turn") % 3
    patches = t.where(at < 2).select("id", F.lit("replace").alias("op"), F.when(at == 0, "/body").otherwise("/status").alias("path"), F.when(at == 0, F.upper("role")).otherwise("hidden").alias("value"), F.col("turn").alias("seq"))
    return changes.apply_patches(t.select("id", F.col("text").alias("body"), F.lit("active").alias("status")), patches).select("id.conv_id", "id.turn", "body", "status")


@query(f"WITH {e.CONV}, patched AS (SELECT id, max_by(value, seq) AS subject FROM (SELECT l_orderkey AS id, CAST(l_partkey AS VARCHAR) AS value, CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey AS seq FROM lineitem WHERE l_orderkey % 50 = 7) GROUP BY id) SELECT conv.id, coalesce(patched.subject, conv.subject) AS subject, status FROM conv LEFT JOIN patched ON patched.id = conv.id")
def patches_in_buckets(spark: SparkSession, sf: str) -> DataFrame:
    """A stored snapshot, of which patches rewrite only the buckets of the ids that they name."""
    snapshot = e.flat_conversations(spark, sf).select("id", "subject", "status")
    table = KeyedTable(spark, shared_path(spark), snapshot.schema, "id", 16)
    table.change(snapshot, lambda rows, new: new, "first")
    line = e.table(spark, sf, "lineitem").where("l_orderkey % 50 = 7")
    patches = line.select(F.col("l_orderkey").alias("id"), F.lit("replace").alias("op"), F.lit("/subject").alias("path"), F.col("l_partkey").cast("string").alias("value"), (F.col("l_linenumber") * F.lit(1_000_000_000).cast("bigint") + F.col("l_partkey")).alias("seq"))
    table.change(patches, changes.apply_patches, "patches")
    return table.rows()


@query(f"WITH {e.CONV} SELECT id, subject, status, modified_at FROM conv")
def incremental_load(spark: SparkSession, sf: str) -> DataFrame:
    """Two loads by the cursor, the first of older versions of some rows: as one full load."""
    full = e.flat_conversations(spark, sf).select("id", "subject", "status", "modified_at")
    halfway, changed = F.to_timestamp_ntz(F.lit("1998-06-01 00:00:00")), F.col("modified_at") >= F.to_timestamp_ntz(F.lit("1998-06-01 00:00:00"))
    older = full.where(changed & (F.col("id") % 3 == 0)).select("id", F.lit("draft").alias("subject"), F.lit("active").alias("status"), (halfway - F.expr("INTERVAL 1 DAY")).alias("modified_at"))
    table = KeyedTable(spark, shared_path(spark), full.schema, "id", 16)
    load_changes(full.where(~changed).union(older), table, "modified_at", "first", store=written)
    load_changes(full, table, "modified_at", "second", store=written)
    load_changes(full, table, "modified_at", "second", store=written)
    return table.rows()


# --- streaming ---


@query("SELECT CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey % 10 END AS agent_id, count(*) FILTER (o_orderstatus NOT IN ('P', 'F')) AS active, count(*) FILTER (o_orderstatus = 'P') AS pending, count(*) FILTER (o_orderstatus = 'F') AS closed FROM orders GROUP BY 1")
def streamed_overview(spark: SparkSession, sf: str) -> DataFrame:
    """Two changes of each conversation as a stream of files, some of which come late, and each file twice."""
    o, key, at = e.table(spark, sf, "orders"), F.col("o_orderkey"), shared_path(spark)
    status = F.when(F.col("o_orderstatus") == "P", "pending").when(F.col("o_orderstatus") == "F", "closed").otherwise("active")
    agent = F.when(key % 7 != 0, F.col("o_custkey") % 10)
    row = lambda a, s, seq: o.select(key.alias("id"), a.alias("agent_id"), s.alias("status"), F.lit(seq).cast("bigint").alias("seq"), F.col("o_orderdate").cast("timestamp").alias("at"))
    first, last = row(F.lit(3).cast("bigint"), F.lit("active"), 1), row(agent, status, 2)
    for rows in (first.where("id % 2 = 0"), last, last, first.where("id % 2 = 1")):
        rows.coalesce(2).write.mode("append").parquet(f"{at}/in")
    stream = spark.readStream.schema(last.schema).option("maxFilesPerTrigger", 2).parquet(f"{at}/in")
    overviews.overview_moves(stream).writeStream.format("parquet").option("checkpointLocation", f"{at}/checkpoint").outputMode("append").trigger(availableNow=True).start(f"{at}/out").awaitTermination()
    return overviews.overview(spark.read.schema(overviews.MOVES).parquet(f"{at}/out"))



@query(ORACLE_SQL["redact_customers"])
def redact_stream_of_customers(spark: SparkSession, sf: str) -> DataFrame:
    """Customers landed as files, redacted as a stream, and read again from the sink."""
    at = shared_path(spark)
    e.customers(spark, sf).write.parquet(f"{at}/in")
    redact_stream(spark, f"{at}/in", f"{at}/out", f"{at}/checkpoint", lambda df: redaction.redact_customer(df, "all")).awaitTermination()
    return spark.read.parquet(f"{at}/out").select("id", "firstName", "lastName", "email", "phone")
