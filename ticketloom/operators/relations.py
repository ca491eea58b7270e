"""Nesting, flattening and following keys between entities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketloom.scratch import written


def embed_threads(conv: DataFrame, threads: DataFrame, key: str = "conv_id", pos: str = "pos") -> DataFrame:
    """Each conversation with its threads as an array in order of ``pos``; empty where there are none."""
    item = F.struct(F.col(pos), *[F.col(c) for c in threads.columns if c not in (key, pos)])
    nested = threads.groupBy(key).agg(F.sort_array(F.collect_list(item)).alias("threads"))
    kind = nested.schema["threads"].dataType
    out = conv.join(nested, conv["id"] == nested[key], "left")
    return out.select(*[conv[c] for c in conv.columns if c != "threads"], F.coalesce(nested["threads"], F.array().cast(kind)).alias("threads"))


def flatten_threads(conv: DataFrame, *arrays: Column | str) -> DataFrame:
    """A row for each thread of the arrays (``threads`` unless others are named), with conv_id and pos."""
    found = [F.coalesce(F.col(a) if isinstance(a, str) else a, F.array()) for a in arrays or ("threads",)]
    return conv.select(F.col("id").alias("conv_id"), F.posexplode(F.concat(*found) if len(found) > 1 else found[0]).alias("pos", "_t")).select("conv_id", "pos", "_t.*")


def conversation_attachments(conv: DataFrame) -> DataFrame:
    """conv_id and the fields of each attachment of each thread."""
    rows = conv.select(F.col("id").alias("conv_id"), F.explode("threads").alias("_t")).select("conv_id", F.explode("_t.attachments").alias("_a"))
    return rows.where(F.col("_a").isNotNull()).select("conv_id", "_a.*")


def children(parents: DataFrame, rows: DataFrame, parent_id: str, key: str) -> DataFrame:
    """Rows whose ``key`` is the id of one of the parents; nothing of the parents is added."""
    return rows.join(parents.select(F.col(parent_id).alias(key)).distinct(), key, "left_semi")


def org_customers(orgs: DataFrame, customers: DataFrame) -> DataFrame:
    return children(orgs, customers, "id", "organization_id")


def org_conversations(orgs: DataFrame, customers: DataFrame, conv: DataFrame) -> DataFrame:
    return children(org_customers(orgs, customers), conv, "id", "customer_id")


def team_members(users: DataFrame, membership: DataFrame) -> DataFrame:
    """team_id with each of its users; ``membership``: team_id, user_id."""
    members = membership.select("team_id", F.col("user_id").alias("id"))
    return members.join(users, "id").select("team_id", *users.columns)


def linked_articles(articles: DataFrame, array: str) -> DataFrame:
    """(article id, other id) for the ids in an array column such as categories or related."""
    return articles.select("id", F.explode(array).alias("other"))


def category_articles(articles: DataFrame, categories: DataFrame) -> DataFrame:
    links = articles.select("*", F.explode("categories").alias("category_id"))
    return links.join(categories.select(F.col("id").alias("category_id")).distinct(), "category_id", "left_semi")


def find_redirects(urls: DataFrame, redirects: DataFrame) -> DataFrame:
    """The redirect of each (site_id, url), for a table of URLs; none gives null."""
    return urls.join(redirects.select("site_id", F.col("url_mapping").alias("url"), "redirect"), ["site_id", "url"], "left")


def resolve_redirects(redirects: DataFrame) -> DataFrame:
    """(site_id, url_mapping, target, hops, looped): where a chain of redirects ends.

    Pointers jump: each round joins every unfinished redirect to the one that it leads to, so a chain of n hops
    takes log2(n) rounds. What is unfinished when pointers span as many hops as there are redirects leads
    into a loop and has no target. Of redirects with equal sites and URLs the smallest counts; a null site is a
    site like any other; a redirect to null ends there.
    """
    one = redirects.where("url_mapping IS NOT NULL").groupBy(F.coalesce(F.concat(F.lit("s"), F.col("site_id").cast("string")), F.lit("")).alias("_site"), "url_mapping").agg(F.min("redirect").alias("target"), F.min("site_id").alias("site_id"))
    left = written(one.select("_site", "site_id", "url_mapping", "target", F.lit(1).cast("bigint").alias("hops")))
    rounds, n = [], left.count()
    for _ in range(max(1, n).bit_length() + 1):
        after = left.select(F.col("_site").alias("_s"), F.col("url_mapping").alias("_u"), F.col("target").alias("_t"), F.col("hops").alias("_h"))
        # Those that are finished stand in ``rounds`` with where they end, and are looked up like the others.
        for done in rounds:
            after = after.union(done.select("_site", "url_mapping", "target", "hops"))
        step = written(left.join(after, (F.col("_site") == F.col("_s")) & (F.col("target") == F.col("_u")), "left"))
        rounds.append(step.where("_u IS NULL").select(*left.columns))
        left = step.where("_u IS NOT NULL").select("_site", "site_id", "url_mapping", F.col("_t").alias("target"), (F.col("hops") + F.col("_h")).alias("hops"))
        if left.isEmpty():
            break
        left = written(left)
    found = reduce(DataFrame.union, rounds).select("site_id", "url_mapping", "target", "hops", F.lit(False).alias("looped"))
    return found.union(left.select("site_id", "url_mapping", F.lit(None).cast("string"), F.lit(None).cast("bigint"), F.lit(True)))


def attach_known_identities(threads: DataFrame, conv: DataFrame) -> DataFrame:
    """Adds ``identities``: customer and assignee of the conversation and the author of the thread, those that exist.

    Persons are structs of type, first, last, email and phone as they were before redaction.
    """
    both = threads.join(conv.select(F.col("id").alias("conv_id"), F.col("customer").alias("_c"), F.col("assignee").alias("_a")), "conv_id", "left")
    return both.withColumn("identities", F.filter(F.array("_c", "_a", "author"), lambda p: p.isNotNull())).drop("_c", "_a")


OPERATIONS = ("read", "write", "delete", "*")


def parse_policy(text: str) -> list[tuple[str, str]]:
    """``resource:operation`` rules, comma-listed; blanks are skipped, anything else malformed is an error; none means no restriction."""
    rules = []
    for part in (p.strip() for p in text.split(",")):
        if not part:
            continue
        resource, colon, operation = (x.strip() for x in part.partition(":"))
        if not colon or not resource or operation not in OPERATIONS:
            raise ValueError(f"not a rule: {part!r}")
        rules.append((resource, operation))
    return rules


def policy_audit(spark: SparkSession, requests: DataFrame, policy: str) -> DataFrame:
    """command, resource, operation and ALLOW or DENY, by command.

    Rules are configuration, a handful of literals, so the test is a filter expression and not a join.
    """
    rules = parse_policy(policy)
    allowed = F.lit(not rules)
    for resource, operation in rules:
        hit = F.lit(True) if resource == "*" else F.col("resource") == resource
        allowed = allowed | (hit & (F.lit(True) if operation == "*" else F.col("operation") == operation))
    return requests.select("command", "resource", "operation", F.when(allowed, "ALLOW").otherwise("DENY").alias("decision")).orderBy("command")
