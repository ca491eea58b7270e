"""Personal-data spans: fixed patterns, and a weakly supervised classifier for what they miss.

Fixed patterns find e-mails, IP addresses, cards and phone numbers. For other identifiers (credentials
and contact numbers without a country code) a wide pattern proposes candidate spans, and labelers vote on
each: shape patterns, a gazetteer of key words before it, and its context. Expectation-maximisation over
the counts of vote patterns estimates how reliable each labeler is; the posteriors then train a logistic
span classifier, which comes out as a column expression. Everything that touches rows is a DataFrame
expression; the driver sees only counts of vote patterns, at most ``2 ** 9`` of them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketloom.llm.common import boxed, held, written

# A run of name characters is tried once, from its start or where the last match ended, and repeats are
# possessive; that finds the same matches in linear time and without deep recursion.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")

SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9_])"
PASSPORT = r"[A-Z]{1,2}[0-9]{6,8}(?![A-Za-z0-9_])"
IBAN = r"[A-Z]{2}[0-9]{2}(?:\x20[A-Z0-9]{4}(?![A-Za-z0-9_])){2,7}(?:\x20[A-Z0-9]{1,3}(?![A-Za-z0-9_]))?"
CANDIDATE = r"(?<![A-Za-z0-9_])(?:(?=[A-Za-z_]*+[0-9])[A-Za-z0-9_]{16,}+|\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])|" + f"{SSN}|{IBAN}|{PASSPORT}|[0-9]{{9}}(?![A-Za-z0-9_]))"
GAZETTEER = ("token", "secret", "key", "apikey", "api_key", "password", "passwd", "pwd", "bearer", "credential", "auth", "tel", "phone", "mobile", "fax", "call", "ssn", "iban", "passport", "account")
VOTES = ("shape", "gazetteer", "assigned", "quoted", "varied")
FEATURES = (*VOTES, "long", "hex", "digits_half", "number")

SPAN = "array<struct<kind:string,start:bigint,end:bigint,match:string>>"


def _found(text: str, kind: str, pattern: str, guard: Column) -> Column:
    """Matches of a pattern with code-point offsets: gaps between matches give where each starts."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    step = lambda a, x: F.struct(
        (a.at + x.gap + F.length(x.hit)).alias("at"),
        F.concat(a.out, F.array(F.struct(F.lit(kind).alias("kind"), (a.at + x.gap).alias("start"), (a.at + x.gap + F.length(x.hit)).alias("end"), x.hit.alias("match")))).alias("out"),
    )
    # Gaps run one past the hits; the last pair has a null hit and goes.
    pairs = F.filter(F.zip_with(F.split(text, pattern, -1), hits, lambda g, m: F.struct(F.length(g).cast("bigint").alias("gap"), m.alias("hit"))), lambda x: x.hit.isNotNull())
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(SPAN).alias("out"))
    return F.coalesce(F.when(guard, F.aggregate(pairs, zero, step, lambda a: a.out)), F.array().cast(SPAN))


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(d: Column) -> Column:
    n = F.length(d)
    def add(a: Column, i: Column) -> Column:
        v = F.substring(d, i, F.lit(1)).cast("int")
        twice = F.when(v > 4, 2 * v - 9).otherwise(2 * v)
        return a + F.when((n - i) % 2 == 1, twice).otherwise(v)
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _card_ok(s: Column) -> Column:
    d = _digits(s.match)
    return F.when(F.length(d).between(13, 19), _luhn(d)).otherwise(False)


def _ip_ok(s: Column) -> Column:
    small = lambda p: F.when(F.length(F.regexp_replace(p, "^0+", "")) <= 3, p.cast("decimal(38,0)") <= 255).otherwise(False)
    return F.forall(F.split(F.regexp_replace(s.match, r"(^|\.)0+(?=[0-9])", "$1"), r"\."), small)


def base_spans(docs: DataFrame) -> DataFrame:
    """Adds ``_t`` (text, null as empty) and one array of spans for each fixed kind."""
    df = held(docs, _t=F.coalesce(F.col("text"), F.lit("")))
    df = held(df, _email=_found("_t", "email", EMAIL, F.contains("_t", F.lit("@"))))
    df = held(df, _ip=_found("_t", "ip", IP, F.regexp_like("_t", F.lit(r"[0-9]\.[0-9]"))))
    df = held(df, _card=_found("_t", "card", CARD, F.regexp_like("_t", F.lit(r"[0-9](?:[\x20-]?[0-9]){12}"))))
    df = held(df, _phone=_found("_t", "phone", PHONE, F.contains("_t", F.lit("+"))))
    return df.withColumns({
        "_ip": F.filter("_ip", _ip_ok),
        "_card": F.filter("_card", _card_ok),
        "_phone": F.filter("_phone", lambda s: F.length(_digits(s.match)).between(9, 15)),
    })


def _votes(df: DataFrame) -> DataFrame:
    """Adds ``_c``: candidate spans outside the base spans, each with its feature flags."""
    df = held(df, _c=_found("_t", "other", CANDIDATE, F.regexp_like("_t", F.lit(r"[0-9]{3}[\x20.)-]|[0-9][A-Za-z0-9_]|[A-Za-z_][0-9]"))))
    clash = lambda c: F.exists(F.concat("_email", "_ip", "_card", "_phone"), lambda b: (b.start < c.end) & (c.start < b.end))
    df = df.withColumn("_c", F.filter("_c", lambda c: ~clash(c)))

    def flags(c: Column) -> Column:
        m = c.match
        left = F.substring(F.col("_t"), (F.greatest(c.start - 40, F.lit(0)) + 1).cast("int"), F.least(c.start, F.lit(40)).cast("int"))
        right = F.substring(F.col("_t"), (c.end + 1).cast("int"), F.lit(1))
        n, d = F.length(m), F.length(_digits(m))
        number = F.regexp_like(m, F.lit("^[(]?[0-9]{3}[)]?[ .-][0-9]{3}"))
        said = {
            "shape": number | F.regexp_like(m, F.lit(f"^(?:{SSN}|{IBAN}|{PASSPORT})$")) | (F.regexp_like(m, F.lit("[A-Za-z]")) & (n >= 20)),
            "gazetteer": F.regexp_like(left, F.lit(r"(?i)(?<![a-z])(?:" + "|".join(GAZETTEER) + r")(?![a-z])[^a-z]{0,12}$")),
            "assigned": F.regexp_like(left, F.lit(r"[=:]\s{0,2}[\"']?$")),
            "quoted": F.regexp_like(left, F.lit("[\"'`]$")) & F.regexp_like(right, F.lit("^[\"'`]")),
            "varied": F.size(F.array_distinct(F.split(F.lower(m), ""))) >= 9,
            "long": n >= 32,
            "hex": F.regexp_like(m, F.lit("^[0-9a-fA-F]+$")),
            "digits_half": 2 * d >= n,
            "number": number,
        }
        return F.struct(c.start.alias("start"), c.end.alias("end"), m.alias("match"), *[F.coalesce(said[k], F.lit(False)).cast("int").alias(k) for k in FEATURES])

    return df.withColumn("_c", F.transform("_c", flags))


@dataclass
class SpanModel:
    """Weights of the span classifier over ``FEATURES`` (last: the constant), and each labeler's hit and false-alarm rate."""

    weights: tuple[float, ...]
    reliability: dict[str, tuple[float, float]]

    def accepts(self, c: Column) -> Column:
        z = F.lit(self.weights[-1])
        for name, w in zip(FEATURES, self.weights, strict=False):
            z = z + F.lit(w) * c[name]
        return z >= 0


def aggregate_votes(votes: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, dict[str, tuple[float, float]]]:
    """Expectation-maximisation over vote patterns: the posterior of each, and (hit, false-alarm) rates."""
    q = np.clip(votes.mean(1), 0.05, 0.95)
    for _ in range(rounds):
        yes, no = counts * q, counts * (1 - q)
        prior = np.clip(yes.sum() / counts.sum(), 0.01, 0.99)
        hit = (yes @ votes + 1) / (yes.sum() + 2)
        false = (no @ votes + 1) / (no.sum() + 2)
        up = np.log(prior) + votes @ np.log(hit) + (1 - votes) @ np.log(1 - hit)
        down = np.log(1 - prior) + votes @ np.log(false) + (1 - votes) @ np.log(1 - false)
        q = 1 / (1 + np.exp(np.clip(down - up, -50, 50)))
    return q, {k: (float(a), float(b)) for k, a, b in zip(VOTES, hit, false, strict=True)}


def learn(candidates: DataFrame) -> SpanModel | None:
    """The model of the votes in ``_c`` of all rows; None where there are no candidates."""
    marks = candidates.select(F.explode("_c").alias("c")).groupBy(*[F.col(f"c.{k}").alias(k) for k in FEATURES]).count().collect()
    if not marks:
        return None
    x = np.array([[r[k] for k in FEATURES] for r in sorted(marks)], float)
    n = np.array([r["count"] for r in sorted(marks)], float)
    q, reliability = aggregate_votes(x[:, : len(VOTES)], n)
    # A class of spans is what most reliable labelers agree on; where the two classes came out swapped, turn them.
    if sum(a for a, _ in reliability.values()) < sum(b for _, b in reliability.values()):
        q, reliability = 1 - q, {k: (b, a) for k, (a, b) in reliability.items()}
    z, w = np.c_[x, np.ones(len(x))], np.zeros(x.shape[1] + 1)
    for _ in range(2000):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w -= 0.5 * (z.T @ (n * (p - q)) / n.sum() + 1e-3 * w)
    return SpanModel(tuple(float(round(v, 6)) for v in w), reliability)


def fit(docs: DataFrame) -> SpanModel | None:
    """Votes on all candidates of all documents; None where there are none."""
    return learn(_votes(base_spans(docs.select("text"))))


def _chosen(df: DataFrame, model: SpanModel | None) -> DataFrame:
    """Adds ``spans`` from the base spans and those of ``_c`` that the model accepts."""
    parts = ["_email", "_ip", "_card", "_phone"]
    if model is not None:
        df = df.withColumn("_more", F.transform(F.filter("_c", model.accepts), lambda c: F.struct(F.when(c.number == 1, "contact").otherwise("secret").alias("kind"), c.start.alias("start"), c.end.alias("end"), c.match.alias("match"))))
        df = df.withColumn("_contact", F.filter("_more", lambda c: c.kind == "contact")).withColumn("_secret", F.filter("_more", lambda c: c.kind == "secret"))
        parts += ["_contact", "_secret"]
    return df.withColumn("spans", F.concat(*parts))


def find(docs: DataFrame, model: SpanModel | None) -> DataFrame:
    """Adds ``spans``: array of (kind, start, end, match), base spans by kind and start, then those of the model.

    Offsets count code points, the end is exclusive. A null or empty text has no spans; repeated rows get
    equal spans; an empty table gives no rows. A column ``spans`` is replaced, all others stay.
    """
    rows, own = boxed(docs, ["text"], ["spans"])
    df = base_spans(rows)
    return _chosen(df if model is None else _votes(df), model).select(*own, "spans")


def find_all(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """``find`` with the model that ``fit`` learns from the same documents, reading each text once: candidates and votes are written in between.

    Without ``keep_text`` the texts themselves are neither written nor returned.
    """
    rows, own = boxed(docs, ["text"], ["spans"])
    voted = _votes(base_spans(rows)).drop("_t")
    voted = written(voted if keep_text else voted.withColumn("text", F.lit(None).cast("string")))
    out = _chosen(voted, learn(voted)).select(*own, "spans")
    return out if keep_text else out.drop("text")


def listed(spans: Column, kinds: Callable[[Column], Column] | None = None) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(F.filter(spans, kinds) if kinds else spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def redact(found: DataFrame) -> DataFrame:
    """Replaces spans in ``text`` by ``[KIND]``; of spans that overlap, the mark of the first stays and all go.

    Texts without spans, null ones too, stay as they are, and so do all other columns.
    """
    df, own = boxed(found, ["text", "spans"])
    df = held(df, _o=F.sort_array(F.transform("spans", lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), s.kind.alias("kind")))))
    cut = lambda a, b: F.substring(F.col("text"), (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int"))
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out"))
    step = lambda a, s: F.struct(F.greatest(a.at, s.end).alias("at"), F.when(s.start < a.at, a.out).otherwise(F.concat(a.out, F.array(F.concat(cut(a.at, s.start), F.lit("["), F.upper(s.kind), F.lit("]"))))).alias("out"))
    df = held(df, _r=F.aggregate("_o", zero, step))
    rest = F.expr("substring(text, cast(_r.at + 1 as int))")
    return df.withColumn("text", F.when(F.size("spans") > 0, F.concat(F.array_join("_r.out", ""), rest)).otherwise(F.col("text"))).select(own)
