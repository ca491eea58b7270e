"""Filters as column builders. Callers combine them with ``&``, ``|`` and ``~``; an absent filter is true."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ticketloom.functions.scalars import _c

CUSTOMER_FACING = ("customer", "reply", "message", "chat", "phone", "beaconchat")


def by_status(status: str = "active", c: Column | str = "status") -> Column:
    return F.lit(True) if status == "all" else _c(c) == status


def by_mailbox(ids: str = "", default: int = 0, c: Column | str = "mailbox_id") -> Column:
    """Ids are comma-listed; without any the default mailbox counts, if there is one."""
    wanted = [int(x) for x in ids.split(",") if x.strip()] or ([default] if default > 0 else [])
    return _c(c).isin(wanted) if wanted else F.lit(True)


def equals(c: Column | str, value: object) -> Column:
    """Folder, number, id, name, slug and other fields by value."""
    return _c(c) == value


def by_tag(names: str, tags: Column | str = "tags") -> Column:
    wanted = [F.lit(x.strip()) for x in names.split(",") if x.strip()]
    return F.arrays_overlap(F.transform(_c(tags), lambda t: t["name"]), F.array(*wanted)) if wanted else F.lit(True)


def assigned_to(user_id: int, assignee: Column | str = "assignee") -> Column:
    return _c(assignee)["id"] == user_id


def assigned_is(name: str, assignee: Column | str = "assignee") -> Column:
    """By full name; ``Unassigned`` asks for rows without assignee."""
    a = _c(assignee)
    return a.isNull() if name == "Unassigned" else F.concat_ws(" ", a["first"], a["last"]) == name


def modified_since(at: Column, c: Column | str = "modified_at") -> Column:
    return _c(c) > at


def by_custom_fields(pairs: list[tuple[int, str]], mailbox: bool, fields: Column | str = "custom_fields") -> Column:
    """Every (id, value) has to be there; custom fields belong to a mailbox, so one must be chosen too."""
    if pairs and not mailbox:
        raise ValueError("custom fields need a mailbox filter")

    def present(key: int, value: str) -> Column:
        return F.exists(_c(fields), lambda x: (x["id"] == key) & (x["value"] == value))

    out = F.lit(True)
    for key, value in pairs:
        out = out & present(key, value)
    return out


def has_phrase(c: Column | str, phrase: str) -> Column:
    return F.contains(F.lower(_c(c)), F.lit(phrase.lower()))


def any_body_has(threads: Column | str, phrase: str) -> Column:
    return F.exists(_c(threads), lambda t: has_phrase(t["body"], phrase))


def free_text(phrase: str, subject: Column | str = "subject", threads: Column | str = "threads") -> Column:
    return F.coalesce(has_phrase(subject, phrase), F.lit(False)) | F.coalesce(any_body_has(threads, phrase), F.lit(False))


def email_is(email: str, *lists: Column | str, customer: Column | str = "customer") -> Column:
    """In any of the address lists (to, cc, bcc), or the customer's."""
    out = F.coalesce(_c(customer)["email"] == email, F.lit(False))
    for x in lists:
        out = out | F.coalesce(F.array_contains(_c(x), email), F.lit(False))
    return out


def customer_ids(ids: list[int], c: Column | str = "customer_id") -> Column:
    return _c(c).isin(ids)


def reply_user_ids(ids: list[int], threads: Column | str = "threads") -> Column:
    return F.exists(_c(threads), lambda t: (t["type"] == "reply") & t["created_by"]["id"].isin(ids))


def has_attachments(threads: Column | str = "threads") -> Column:
    return F.exists(_c(threads), lambda t: F.size(t["attachments"]) > 0)


def date_between(c: Column | str, low: Column | None = None, high: Column | None = None) -> Column:
    """Both ends count; None is an open end."""
    out = F.lit(True)
    if low is not None:
        out = out & (_c(c) >= low)
    if high is not None:
        out = out & (_c(c) <= high)
    return out


def relative_since(c: Column | str, as_of: Column, n: int, unit: str) -> Column:
    if unit.upper() not in ("MINUTE", "HOUR", "DAY", "WEEK", "MONTH", "YEAR"):
        raise ValueError(f"unknown unit {unit!r}")
    return _c(c) >= as_of - F.expr(f"INTERVAL {int(n)} {unit.upper()}")


def in_month(c: Column | str, month: str) -> Column:
    """``YYYY-MM`` as a half-open range, so that the filter reaches the scan."""
    year, number = map(int, month.split("-"))
    after = f"{year + number // 12:04d}-{number % 12 + 1:02d}-01"
    return (_c(c) >= F.to_timestamp_ntz(F.lit(f"{month}-01 00:00:00"))) & (_c(c) < F.to_timestamp_ntz(F.lit(f"{after} 00:00:00")))


def is_sentinel(p: Column | str) -> Column:
    """A placeholder person: id 0, or the e-mail ``unknown`` in any case."""
    p = _c(p)
    return F.coalesce(p["id"] == 0, F.lit(False)) | F.coalesce(F.lower(p["email"]) == "unknown", F.lit(False))


def is_customer_facing(kind: Column | str) -> Column:
    return _c(kind).isin(*CUSTOMER_FACING)


def is_open(status: Column | str) -> Column:
    return _c(status) != "closed"


def status_bucket(status: Column | str) -> Column:
    """``pending``, ``closed``, and ``active`` for all else."""
    return F.when(_c(status).isin("pending", "closed"), _c(status)).otherwise("active")


def by_collection_or_category(collection: str | None, category: str | None) -> Column:
    """Articles are listed for one of them; the category wins if both are given."""
    if not collection and not category:
        raise ValueError("a collection or a category is required")
    return F.array_contains("categories", category) if category else F.col("collection_id") == collection


def by_article_status(status: str, c: Column | str = "status") -> Column:
    if status not in ("published", "notpublished", "all"):
        raise ValueError(f"unknown article status {status!r}")
    return F.lit(True) if status == "all" else _c(c) == status


def workflows(mailbox_id: int = 0, kind: str = "") -> Column:
    """A mailbox counts from 1 on, a type where one is given."""
    return (F.col("mailbox_id") == mailbox_id if mailbox_id > 0 else F.lit(True)) & (F.col("type") == kind if kind else F.lit(True))


def _says(phrase: str, *columns: str) -> Column:
    """Any of the columns has the phrase; without a phrase all rows pass."""
    out = F.lit(not phrase)
    for c in columns if phrase else ():
        out = out | F.coalesce(has_phrase(c, phrase), F.lit(False))
    return out


def saved_replies(mailbox_id: int = 0, phrase: str = "") -> Column:
    return (F.col("mailbox_id") == mailbox_id if mailbox_id > 0 else F.lit(True)) & _says(phrase, "name", "text")


def organizations(phrase: str = "") -> Column:
    return _says(phrase, "name", "domain")


def by_visibility(visibility: str = "all", c: Column | str = "visibility") -> Column:
    if visibility not in ("public", "private", "all"):
        raise ValueError(f"unknown visibility {visibility!r}")
    return F.lit(True) if visibility == "all" else _c(c) == visibility


def collections(site: str | None = None, visibility: str = "all") -> Column:
    return (F.col("site_id") == site if site else F.lit(True)) & by_visibility(visibility)


def article_search(phrase: str, collection: str | None = None, site: str | None = None, status: str = "all", visibility: str = "all") -> Column:
    """Articles whose name or text has the phrase, in a collection, on a site, of a status and a visibility, where these are given."""
    out = _says(phrase, "name", "text") & by_article_status(status) & by_visibility(visibility)
    for c, value in (("collectionId", collection), ("site_id", site)):
        out = out & (F.col(c) == value if value else F.lit(True))
    return out
