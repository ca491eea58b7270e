"""Scalar column builders: times, display texts, HTML."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(_c(c), F.lit(""))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def text_or_empty(c: Column | str) -> Column:
    return F.coalesce(_c(c), F.lit(""))


def parse_iso(c: Column | str) -> Column:
    """ISO time with an offset or ``Z``, or a date alone (midnight UTC), as a timestamp; anything else is null."""
    c = _c(c)
    full = F.regexp_like(c, F.lit(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"))
    day = F.regexp_like(c, F.lit(r"^\d{4}-\d{2}-\d{2}$"))
    return F.when(full, c.try_cast("timestamp")).when(day, F.concat(c, F.lit("T00:00:00Z")).try_cast("timestamp"))


def seconds_between(a: Column, b: Column) -> Column:
    """From ``a`` to ``b``, with microseconds."""
    return (F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))) / F.lit(1_000_000)


def relative_time(c: Column | str, as_of: Column) -> Column:
    """``just now``, ``5m ago``, ``3h ago``, days, months of 30 and years of 365 days; what isn't a time comes back as it is."""
    s = F.floor(seconds_between(parse_iso(c), as_of))
    steps = [(60, 1, None), (3600, 60, "m ago"), (86_400, 3600, "h ago"), (30 * 86_400, 86_400, "d ago"), (365 * 86_400, 30 * 86_400, "mo ago")]
    out = None
    for below, unit, label in steps:
        shown = F.lit("just now") if label is None else F.concat(F.floor(s / unit).cast("string"), F.lit(label))
        out = F.when(s < below, shown) if out is None else out.when(s < below, shown)
    years = F.concat(F.floor(s / (365 * 86_400)).cast("string"), F.lit("y ago"))
    return F.when(s.isNull(), _c(c)).otherwise(out.otherwise(years))


def trim_space(c: Column | str) -> Column:
    return F.regexp_replace(_c(c), r"^\s+|\s+$", "")


def full_name(first: Column | str, last: Column | str) -> Column:
    return trim_space(F.concat(text_or_empty(first), F.lit(" "), text_or_empty(last)))


def format_person(p: Column | str) -> Column:
    """``First Last (email)``, the e-mail alone, or the name alone; empty for no person."""
    p = _c(p)
    name, email = full_name(p["first"], p["last"]), text_or_empty(p["email"])
    both = F.when((email != "") & (name != ""), F.concat(name, F.lit(" ("), email, F.lit(")"))).when(email != "", email).otherwise(name)
    return F.when(p.isNull(), "").otherwise(both)


def truncate(c: Column | str, n: int) -> Column:
    """At most ``n`` characters, the last three of which are dots if something was cut."""
    c = _c(c)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n - 3), F.lit("..."))).otherwise(c)


def format_bytes(c: Column | str) -> Column:
    c = _c(c)
    return F.when(c >= 1 << 20, F.format_string("%.1fMB", c / F.lit(float(1 << 20)))).when(c >= 1 << 10, F.concat(F.shiftright(c, 10).cast("string"), F.lit("KB"))).otherwise(F.concat(c.cast("string"), F.lit("B")))


def strip_tags(c: Column | str) -> Column:
    """Removes ``<...>`` and outer space; what stands between tags stays, scripts and entities too."""
    return trim_space(F.regexp_replace(_c(c), "<[^>]*>", ""))


#: What ``html_to_markdown`` understands, in order.
_HTML = [
    (r"(?is)<(script|style|head)\b[^>]*>.*?</\1\s*>", ""),
    (r"(?is)<(?:strong|b)(?:\s[^>]*)?>(.*?)</(?:strong|b)\s*>", r"**$1**"),
    (r"(?is)<(?:em|i)(?:\s[^>]*)?>(.*?)</(?:em|i)\s*>", r"*$1*"),
    (r"(?is)<code(?:\s[^>]*)?>(.*?)</code\s*>", r"`$1`"),
    (r"""(?is)<a\s[^>]*?href\s*=\s*["']([^"']*)["'][^>]*>(.*?)</a\s*>""", r"[$2]($1)"),
    *[(rf"(?is)<h{k}(?:\s[^>]*)?>(.*?)</h{k}\s*>", "\n\n" + "#" * k + " $1\n\n") for k in range(1, 7)],
    (r"(?i)<br\s*/?>", "\n"),
    (r"(?is)<li(?:\s[^>]*)?>(.*?)</li\s*>", "\n- $1"),
    (r"(?i)</?(?:p|div|ul|ol|tr|table)(?:\s[^>]*)?>", "\n\n"),
    (r"<[^>]*>", ""),
    ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&"),
    (r"\n{3,}", "\n\n"),
]


def html_to_markdown(c: Column | str) -> Column:
    """A documented subset: bold, emphasis, code, links, headings, lists, breaks, paragraphs and five entities.

    Other tags go. This isn't a full converter: nesting of equal tags, tables and images aren't rendered.
    """
    c = _c(c)
    for pattern, put in _HTML:
        c = F.regexp_replace(c, pattern, put)
    return trim_space(c)


def round2(c: Column) -> Column:
    return F.round(c, 2)


def json_scalar(c: Column | str, path: str) -> Column:
    """A scalar of an untyped JSON document as text: whole numbers without decimals, nothing for null."""
    v = F.get_json_object(_c(c), path)
    return text_or_empty(F.regexp_replace(v, r"^(-?\d+)\.0+$", "$1"))


def joined(items: Column | str, field: str | None = None, by: str = ";") -> Column:
    items = _c(items)
    return text_or_empty(F.array_join(F.transform(items, lambda x: x[field]) if field else items, by))


def customer_display(p: Column | str) -> Column:
    p = _c(p)
    return text_or_empty(F.coalesce(blank_to_null(p["email"]), full_name(p["first"], p["last"])))


def assignee_display(p: Column | str) -> Column:
    p = _c(p)
    return F.when(p.isNull(), "unassigned").otherwise(text_or_empty(F.coalesce(blank_to_null(full_name(p["first"], p["last"])), p["email"])))


def thread_body(body: Column | str, action_text: Column | str) -> Column:
    return text_or_empty(F.coalesce(blank_to_null(body), _c(action_text)))


def thread_author_type(kind: Column | str) -> Column:
    return F.when(F.lower(trim_space(kind)).isin("customer", "chat", "beaconchat", "phone"), "customer").otherwise("user")


def shown_minutes(c: Column | str) -> Column:
    """Whole minutes, halves to even; ``-`` for none."""
    return F.coalesce(F.rint(_c(c)).cast("bigint").cast("string"), F.lit("-"))


def shown_days(c: Column | str) -> Column:
    return F.when(_c(c).isNull(), "-").otherwise(F.format_string("%.1f", F.bround(_c(c), 1)))


def parse_assignments(pairs: list[str]) -> list[tuple[int, str]]:
    """``id=value`` settings as pairs; the value is kept as it is. A missing ``=`` or an id that is no integer is an error."""
    out = []
    for pair in pairs:
        key, eq, value = pair.partition("=")
        if not eq or not key.strip().lstrip("+-").isdigit():
            raise ValueError(f"expected id=value, got {pair!r}")
        out.append((int(key), value))
    return out
