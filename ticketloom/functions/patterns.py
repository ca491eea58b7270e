"""Ordered pattern rules for free text, rewritten match by match without a UDF."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketloom.functions.pseudonyms import only_digits, token
from ticketloom.functions.scalars import _bound, _c

# Which text is replaced depends on these patterns and on their order.
RULES: list[tuple[str, str]] = [
    ("email", r"(?i)([A-Za-z0-9!#$%&'*+\/=?^_{|.}~-]+@(?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\.)+[a-z0-9](?:[a-z0-9-]*[a-z0-9])?)"),
    ("phone", r"(?i)(?:(?:\+?1\s*(?:[.-]\s*)?)?(?:\(\s*(?:[2-9]1[02-9]|[2-9][02-8]1|[2-9][02-8][02-9])\s*\)|(?:[2-9]1[02-9]|[2-9][02-8]1|[2-9][02-8][02-9]))\s*(?:[.-]\s*)?)?(?:[2-9]1[02-9]|[2-9][02-9]1|[2-9][02-9]{2})\s*(?:[.-]\s*)?(?:[0-9]{4})(?:\s*(?:#|x\.?|ext\.?|extension)\s*(?:\d+)?)"),
    ("phone", r"(?:(?:\+?\d{1,3}[-.\s*]?)?(?:\(?\d{3}\)?[-.\s*]?)?\d{3}[-.\s*]?\d{4,6})|(?:(?:(?:\(\+?\d{2}\))|(?:\+?\d{2}))\s*\d{2}\s*\d{3}\s*\d{4})"),
    ("ssn", r"\d{3}[- ]?\d{2}[- ]?\d{4}"),
    ("credit_card", r"(?:(?:(?:\d{4}[- ]?){3}\d{4}|\d{15,16}))"),
    ("iban", r"[A-Z]{2}\d{2}[A-Z0-9]{4}\d{7}([A-Z\d]?){0,16}"),
    ("btc", r"[13][a-km-zA-HJ-NP-Z1-9]{25,34}"),
    ("btc", r"(?i)bc1[ac-hj-np-z02-9]{6,87}"),
    ("ipv4", r"(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)"),
    ("ipv6", r"\b(?:[0-9A-Fa-f]{1,4}:){2,7}[0-9A-Fa-f]{1,4}\b"),
    ("mac", r"(([a-fA-F0-9]{2}[:-]){5}([a-fA-F0-9]{2}))"),
    ("address", r"(?i)(lives at|located at|resides at|found at|situated at|at address|address is|at location|based at) (\d+[^\n\.]*?(Street|St|Avenue|Ave|Road|Rd|Drive|Dr|Lane|Ln|Place|Pl|Boulevard|Blvd|Way)[^\n\.]*)"),
    ("address", r"(?i)(:\s+|at\s+|@\s+)(\d+[-\s]?\w*|\d+-\d+-\d+)[\s,]+([A-Za-z\p{L}]+([\s'-][A-Za-z\p{L}]+)*[\s,]+)+(Road|Rd|Street|St|Avenue|Ave|Boulevard|Blvd|Drive|Dr|Lane|Ln|Place|Pl|Rue|Via|Viale|Strasse|Straße|Calle|Avenida)"),
    ("address", r"(?i)(\d+[-\s]?\w*|\d+-\d+-\d+)[\s,]+([A-Za-z\p{L}]+([\s'-][A-Za-z\p{L}]+)*[\s,]+)+(Street|St|Avenue|Ave|Road|Rd|Drive|Dr|Lane|Ln|Place|Pl|Boulevard|Blvd|Way|Plaza|Square|Sq|Court|Ct|Terrace|Ter|Circle|Cir|Alley|Row|Highway|Hwy|Parkway|Pkwy|Path|Trail|Tr|Crescent|Cres|Rue|Strasse|Straße|Calle|Via|Viale|Avenida|Carrer|Straat|Gasse|Weg|Camino|Ulica|Utca|Prospekt|Dori|Jalan|Marg|Dao|Jie|Lu|út|de la|del|di|van|von)\b"),
    ("zip", r"\b\d{5}(?:[-\s]\d{4})?\b"),
    ("po_box", r"(?i)P\.? ?O\.? Box \d+"),
    ("url", r"""(?:(?:https?:\/\/)?(?:[a-z0-9.\-]+|www|[a-z0-9.\-])[.](?:[^\s()<>]+|\((?:[^\s()<>]+|(?:\([^\s()<>]+\)))*\))+(?:\((?:[^\s()<>]+|(?:\([^\s()<>]+\)))*\)|[^\s!()\[\]{};:'".,<>?]))"""),
]
SSN_CONTEXT = r"(?i)SSN|social security"

_WORD_EDGE = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"


# How Java matches the rules whose repeated groups it would go through by recursion or again and again: the same
# matches in one pass, with possessive repeats.
#: A word of letters, joined by single apostrophes or hyphens, and the blanks and commas after it.
_STEP = r"\p{L}++(?:['-]\p{L}++)*+[\s,]++"
_NUMBER = r"(?:\d++[-\s]?\w*+|\d++-\d++-\d++)[\s,]++"
#: The first digits of a word of ASCII characters, or its last: others end where the first ones do.
_DIGITS = r"(?:(?<![0-9]\w{0,64})|(?<![0-9])(?=\d++(?!\w)))"


def _up_to_last(street: str) -> str:
    """Words up to the last street word that a run of words leads to, then that word.

    Each round takes a word, and more until a street word is next; the last round that ends at one counts.
    """
    return rf"(?:{_STEP}(?:(?!{street}){_STEP})*+(?={street}))++{street}"


def _one_pass(pattern: str) -> str:
    kinds = {
        # A run of name characters is tried from its start or from the last match on; the host's labels end in a letter or digit.
        "email": r"(?i)(?:(?<![A-Za-z0-9!#$%&'*+\/=?^_{|.}~-])|\G)[A-Za-z0-9!#$%&'*+\/=?^_{|.}~-]++@[a-z0-9]++(?:-++[a-z0-9]++)*+(?:\.[a-z0-9]++(?:-++[a-z0-9]++)*+)++",
        # After the first dot come a character or bracket, then marks and others in turns, not ending in a mark; a later dot
        # gives the same end. A host is tried from its start.
        "url": r"""(?:(?<![a-z0-9.\-])|\G|(?=https?://))(?:https?://)?[a-z0-9.\-][a-z0-9\-]*+[.](?:[^\s()<>]|{B})(?:[!\[\]{};:'".,?]*+(?:[^\s()<>!\[\]{};:'".,?]++|{B}))++""".replace("{B}", r"\((?:[^\s()<>]++|\([^\s()<>]++\))*+\)"),
    }
    kind = {p: k for k, p in RULES}[pattern]
    if kind in kinds:
        return kinds[kind]
    # The last group of an address rule that goes word by word is its street words.
    if kind == "address" and "[A-Za-z\\p{L}]+" in pattern:
        edge = r"\b" if pattern.endswith(r"\b") else ""
        street = f"(?:{pattern.removesuffix(edge).rpartition('(')[2]}{edge}"
        lead = r"(?i)(?::\s++|at\s++|@\s++)" if pattern.startswith("(?i)(:") else f"(?i){_DIGITS}"
        return lead + _NUMBER + _up_to_last(street)
    return pattern


def java(pattern: str) -> str:
    r"""The pattern for Java: ``\b`` by ASCII words, case folded over all of Unicode, and rules in one pass."""
    known = any(pattern == p for _, p in RULES)
    return (_one_pass(pattern) if known else pattern).replace(r"\b", _WORD_EDGE).replace("(?i)", "(?iu)")


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str

    def may_match(self, c: Column) -> Column:
        """A cheap test that holds for every text that the pattern matches in."""
        if self.kind == "email":
            return F.contains(c, F.lit("@"))
        if self.kind == "url":
            return F.contains(c, F.lit("."))
        if self.kind in ("ipv6", "mac"):
            return F.regexp_like(c, F.lit("[:-]"))
        return F.regexp_like(c, F.lit("[0-9]"))


DEFAULT_RULES = [Rule(k, p) for k, p in RULES]
#: Set around matches for a moment; a text that holds it already is gone through twice instead.
_MARK = "\ue000\ue001"


def rewritten(c: Column | str, pattern: str, put: Callable[[Column], Column]) -> Column:
    """Every match, left to right and without overlap, replaced by ``put(match)``; the pattern must not match emptiness.

    Matches are marked in one pass and cut out at the marks; a text without any is done then.
    """
    c = _c(c)
    parts = lambda marked: F.transform(F.split(marked, _MARK, -1), lambda part, i: F.when(i % 2 == 1, put(part)).otherwise(part))
    once = _bound(F.regexp_replace(c, f"(?:{pattern})", f"{_MARK}$0{_MARK}"), lambda m: F.when(F.contains(m, F.lit(_MARK)), F.array_join(parts(m), "")).otherwise(m))
    twice = F.zip_with(F.split(c, pattern, -1), F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), lambda gap, m: F.when(m.isNull(), gap).otherwise(F.concat(gap, put(m))))
    return F.when(F.contains(c, F.lit(_MARK)), F.array_join(twice, "")).otherwise(once)


def rules_on_each(texts: Column, rules: list[Rule] | None = None, secret: str = "") -> Column:
    """``apply_rules`` for each text of an array, one transform for each rule."""

    def put(said: Column, kind: str) -> Callable[[Column], Column]:
        def one(m: Column) -> Column:
            if kind != "ssn":
                return token(kind, m, secret)
            digits = only_digits(m)
            sure = F.regexp_like(m, F.lit("[- ]")) | (said & (F.length(digits) == 9))
            return F.when(sure, token(kind, digits, secret)).otherwise(m)

        return one

    def step(rule: Rule) -> Callable[[Column], Column]:
        return lambda x: F.struct(F.when(rule.may_match(x["text"]), rewritten(x["text"], java(rule.pattern), put(x["ssn"], rule.kind))).otherwise(x["text"]).alias("text"), x["ssn"].alias("ssn"))

    out = F.transform(texts, lambda t: F.struct(t.alias("text"), F.regexp_like(t, F.lit(java(SSN_CONTEXT))).alias("ssn")))
    for rule in DEFAULT_RULES if rules is None else rules:
        out = F.transform(out, step(rule))
    return F.transform(out, lambda x: x["text"])


def apply_rules(df: DataFrame, column: str, rules: list[Rule] | None = None, secret: str = "") -> DataFrame:
    """Replaces what the rules match in ``column`` by tokens, each rule on the text that the ones before it left.

    One projection for each rule keeps the plan as long as the rules are. Null stays null.
    """
    mentioned = "_ssn_mentioned"
    df = df.withColumn(mentioned, F.regexp_like(column, F.lit(java(SSN_CONTEXT))))
    for rule in DEFAULT_RULES if rules is None else rules:
        def put(m: Column, kind: str = rule.kind) -> Column:
            if kind != "ssn":
                return token(kind, m, secret)
            digits = only_digits(m)
            sure = F.regexp_like(m, F.lit("[- ]")) | (F.col(mentioned) & (F.length(digits) == 9))
            return F.when(sure, token(kind, digits, secret)).otherwise(m)

        df = df.withColumn(column, F.when(rule.may_match(F.col(column)), rewritten(column, java(rule.pattern), put)).otherwise(F.col(column)))
    return df.drop(mentioned)


def count_hits(df: DataFrame, column: str, rules: list[Rule] | None = None) -> DataFrame:
    """``df`` without ``column``, and ``rule_0``, ``rule_1``, ...: how often each rule matches in it; a null text is tried by every rule."""
    hits = lambda r: F.size(F.regexp_extract_all(column, F.lit(java(r.pattern)), F.lit(0)))
    found = [F.when(r.may_match(F.col(column)) | F.col(column).isNull(), hits(r)).otherwise(0).alias(f"rule_{i}") for i, r in enumerate(DEFAULT_RULES if rules is None else rules)]
    return df.select(*[c for c in df.columns if c != column], *found)
