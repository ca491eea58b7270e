"""Help-desk entities from the driver's tables, each with the same mapping in SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The time that "now" stands for.
AS_OF = "2001-08-01 00:00:00"


def as_of() -> Column:
    return F.to_timestamp_ntz(F.lit(AS_OF))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _email(name: str) -> Column:
    return F.concat(F.lower(F.replace(F.col(name), F.lit("#"), F.lit("."))), F.lit("@example.com"))


def agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias("id"), F.lit("user").alias("type"), F.lit("Agent").alias("first"), F.col("s_name").alias("last"), _email("s_name").alias("email"), (F.col("s_nationkey") % 10).alias("team_id"))


AGENTS = "agents AS (SELECT s_suppkey AS id, 'Agent' AS first, s_name AS last, lower(replace(s_name, '#', '.')) || '@example.com' AS email, s_nationkey % 10 AS team_id FROM supplier)"


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").alias("id"), F.lit("Customer").alias("firstName"), F.col("c_name").alias("lastName"), _email("c_name").alias("email"),
        F.concat(F.lit("+1 (555) "), F.lpad((F.col("c_custkey") % 10_000_000).cast("string"), 7, "0")).alias("phone"),
        F.col("c_nationkey").alias("organization_id"), F.col("c_mktsegment").alias("background"), F.lit("customer").alias("type"), F.lit("1998-01-02T03:04:05Z").alias("createdAt"),
    )


CUSTOMERS = """customers AS (SELECT c_custkey AS id, 'Customer' AS "firstName", c_name AS "lastName", lower(replace(c_name, '#', '.')) || '@example.com' AS email,
  '+1 (555) ' || lpad(CAST(c_custkey % 10000000 AS VARCHAR), 7, '0') AS phone, c_nationkey AS organization_id, c_mktsegment AS background, '1998-01-02T03:04:05Z' AS "createdAt" FROM customer)"""


def flat_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as conversations with ids of customer and agent."""
    o, n = table(spark, sf_dir, "orders"), agents(spark, sf_dir).agg(F.count(F.lit(1))).scalar()
    key = F.col("o_orderkey")
    return o.select(
        key.alias("id"), key.alias("number"), F.concat(F.col("o_orderpriority"), F.lit(" order "), key.cast("string")).alias("subject"),
        F.when(F.col("o_orderstatus") == "P", "pending").when(F.col("o_orderstatus") == "F", "closed").otherwise("active").alias("status"),
        F.when(key % 3 == 0, "email").when(key % 3 == 1, "chat").otherwise("phone").alias("type"),
        (key % 5).alias("mailbox_id"), (key % 11).alias("folder_id"), F.array(F.struct(F.col("o_orderpriority").alias("name"))).alias("tags"),
        F.col("o_custkey").alias("customer_id"), F.when(key % 7 != 0, F.col("o_custkey") % n).alias("agent_id"),
        F.col("o_orderdate").alias("modified_at"), F.col("o_orderdate").alias("at"), F.array(F.struct(F.lit(7).alias("id"), (key % 4).cast("string").alias("value"))).alias("custom_fields"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("updated_at"),
    )


CONV = """conv AS (SELECT o_orderkey AS id, o_orderkey AS number, o_orderpriority || ' order ' || o_orderkey AS subject,
  CASE o_orderstatus WHEN 'P' THEN 'pending' WHEN 'F' THEN 'closed' ELSE 'active' END AS status,
  CASE o_orderkey % 3 WHEN 0 THEN 'email' WHEN 1 THEN 'chat' ELSE 'phone' END AS type, o_orderkey % 5 AS mailbox_id, o_orderkey % 11 AS folder_id, o_orderpriority AS tag,
  o_custkey AS customer_id, CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey % (SELECT count(*) FROM supplier) END AS agent_id, o_orderdate AS modified_at,
  CAST(o_orderkey % 4 AS VARCHAR) AS field_value, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS updated_at FROM orders)"""


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the agent as a person; the agents are joined by Spark's choice of strategy."""
    person = agents(spark, sf_dir).select(F.col("id").alias("agent_id"), F.struct("id", "type", "first", "last", "email").alias("assignee"))
    return flat_conversations(spark, sf_dir).join(person, "agent_id", "left")


def with_customers(conv: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    c = customers(spark, sf_dir)
    person = c.select(F.col("id").alias("customer_id"), F.struct("id", "type", F.col("firstName").alias("first"), F.col("lastName").alias("last"), "email").alias("customer"))
    return conv.join(person, "customer_id", "left")


def text_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of the conversations table as threads with bodies."""
    t = table(spark, sf_dir, "conversations")
    kind = F.when(F.col("role") == "user", "customer").when(F.col("role") == "assistant", "reply").otherwise("note")
    files = F.when(F.col("turn") % 3 == 0, F.array(F.struct((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.concat(F.lit("file"), F.col("turn").cast("string"), F.lit(".pdf")).alias("filename"), F.lit("application/pdf").alias("mimeType"), F.length("text").cast("bigint").alias("size"))))
    return t.select("conv_id", F.col("turn").alias("pos"), kind.alias("type"), F.col("text").alias("body"), F.struct((F.col("conv_id") % 10).alias("id")).alias("created_by"), F.coalesce(files, F.array().cast("array<struct<id:bigint,filename:string,mimeType:string,size:bigint>>")).alias("attachments"))


TEXT_THREADS = """tthreads AS (SELECT conv_id, turn AS pos, CASE role WHEN 'user' THEN 'customer' WHEN 'assistant' THEN 'reply' ELSE 'note' END AS type, text AS body, conv_id % 10 AS author_id,
  turn % 3 = 0 AS has_file, conv_id * 100 + turn AS file_id, 'file' || turn || '.pdf' AS filename, length(text) AS size FROM conversations)"""


#: The two words that a text opens with.
_TWO = r"^([\p{L}\p{N}]+) ([\p{L}\p{N}]+)"


def openers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A person for each conversation, called like its first two words: conv_id, first, last, email."""
    t = table(spark, sf_dir, "conversations").where("turn = 0")
    first, last = (F.regexp_extract("text", _TWO, i) for i in (1, 2))
    return t.where(first != "").select("conv_id", first.alias("first"), last.alias("last"), F.lower(F.concat(first, F.lit("."), last, F.lit("@example.com"))).alias("email"))


OPENERS = rf"""openers AS (SELECT conv_id, first, last, lower(first || '.' || last || '@example.com') AS email
  FROM (SELECT conv_id, regexp_extract(text, '{_TWO}', 1) AS first, regexp_extract(text, '{_TWO}', 2) AS last FROM conversations WHERE turn = 0) WHERE first <> '')"""


#: Two and three words of which the first has a capital.
_NAME_TWO, _NAME_THREE = r"\p{Lu}\p{L}+ \p{L}+", r"\p{Lu}\p{L}+ \p{L}+ \p{L}+"


def spoken_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of two and three words, as the benchmark's texts have them; documents and turns repeat some."""
    t = table(spark, sf_dir, "benchmark")
    said = F.when(F.col("item_id") % 2 == 0, F.regexp_extract_all("text", F.lit(_NAME_TWO), F.lit(0))).otherwise(F.regexp_extract_all("text", F.lit(_NAME_THREE), F.lit(0)))
    return t.select(F.explode(said).alias("name")).distinct()


SPOKEN_NAMES = f"spoken AS (SELECT DISTINCT name FROM (SELECT unnest(CASE WHEN item_id % 2 = 0 THEN regexp_extract_all(text, '{_NAME_TWO}') ELSE regexp_extract_all(text, '{_NAME_THREE}') END) AS name FROM benchmark))"


def turn_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """These names, and those of the persons that conversations open with."""
    return spoken_names(spark, sf_dir).union(openers(spark, sf_dir).select(F.concat_ws(" ", "first", "last").alias("name"))).distinct()


TURN_NAMES = f"{OPENERS}, {SPOKEN_NAMES.replace('spoken AS', 'said AS')}, spoken AS (SELECT name FROM said UNION SELECT first || ' ' || last FROM openers)"


def timed_threads(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Events by user as (conversations, threads) with times; order is by time and event id."""
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "purchase", "reply").when(F.col("event_type") == "view", "note").when(F.col("event_type") == "error", "lineitem").otherwise("customer")
    threads = e.select(F.col("user_id").alias("conv_id"), F.struct("ts", "event_id").alias("pos"), kind.alias("type"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"), F.col("ts").alias("created_ts"), (F.col("event_id") % 3).alias("n_attachments"))
    return e.groupBy(F.col("user_id").alias("id")).agg(F.min("ts").alias("created_at")), threads


TIMED_THREADS = """ethreads AS (SELECT user_id AS conv_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos,
  CASE event_type WHEN 'purchase' THEN 'reply' WHEN 'view' THEN 'note' WHEN 'error' THEN 'lineitem' ELSE 'customer' END AS type, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS created_at, event_id % 3 AS n_attachments FROM events)"""


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    key = F.col("doc_id")
    return d.select(
        key.alias("id"), F.concat(F.lit("Article "), key.cast("string")).alias("name"), F.concat(F.lit("article-"), key.cast("string")).alias("slug"),
        F.when(key % 4 == 0, "notpublished").otherwise("published").alias("status"), F.col("source").alias("collectionId"), F.array(key % 6, key % 9 + 10).alias("categories"),
        F.array(key + 1, key + 2).alias("related"), F.col("n_chars").alias("views"), F.col("lang").alias("site_id"), "text",
    )


ARTICLES = """articles AS (SELECT doc_id AS id, 'Article ' || doc_id AS name, 'article-' || doc_id AS slug, CASE WHEN doc_id % 4 = 0 THEN 'notpublished' ELSE 'published' END AS status,
  source AS "collectionId", [doc_id % 6, doc_id % 9 + 10] AS categories, [doc_id + 1, doc_id + 2] AS related, n_chars AS views, lang AS site_id, text FROM documents)"""
