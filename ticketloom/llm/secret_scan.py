"""Secret scans: a trigram index narrows texts down to those that a rule can match at all.

From each rule's regular expression a Boolean query of trigrams is derived: in any match, all trigrams of at
least one of its clauses stand in the text, in some case. The index is a stored table of postings (trigram,
text); the posting lists of a clause are intersected by one aggregation, and texts that have a whole clause
are candidates. Only candidates are read by those rules. Rules without mandatory trigrams read every text.

Candidates reach the texts as a bitmap of fixed size. What it lets through by chance is verified like the
rest, so results don't depend on it; a corpus that fills it is read in full, which costs less than dealing
out its texts would. Everything that touches rows is a DataFrame expression.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from itertools import groupby, product
from re import _constants as C
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketloom.llm.common import ascii_lower, boxed, held, written
from ticketloom.llm.pii_spans import SPAN, _found


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern``, leftmost and without overlap, whose ``group`` has ``least`` characters or more. ASCII letters match in either case if ``any_case``."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    any_case: bool = False

    @property
    def regex(self) -> str:
        return f"(?i){self.pattern}" if self.any_case else self.pattern


BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 16),
    # Runs of 32 or more are those of any length that are long enough.
    Rule("hex", r"[0-9a-f]{32,}", 32),
)
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("gitlab", r"glpat-[A-Za-z0-9_-]{20,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[prs]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |PGP )?PRIVATE KEY(?: BLOCK)?-----"),
    Rule("bearer", r"[Bb]earer\x20+[A-Za-z0-9._~+/-]{20,}"),
    Rule("login", r"[a-z][a-z0-9+.-]{1,15}://[^\x20\x09-\x0D/:@]{1,64}:[^\x20\x09-\x0D/@]{1,128}@"),
)
RULES = (*BASE, *MORE)

#: Most spellings of a pattern that are followed one by one; what would make more of them counts as a gap.
SPELLINGS, CLASS, COPIES = 64, 6, 4
#: Parts of a set of texts, and bits of each: four megabytes in all, whatever the corpus.
PARTS, BITS = 1024, 32768
GAP = {("", "")}


def _joined(parts: list[set[tuple[str, ...]]]) -> set[tuple[str, ...]]:
    """Spellings of parts in a row. A spelling is what must stand in the text: fragments, with gaps of anything between them."""

    def both(a: set, b: set) -> set:
        out = {(*x[:-1], x[-1] + y[0], *y[1:]) for x, y in product(a, b)}
        return out if len(out) <= SPELLINGS else {(*x, "") for x in a}

    return reduce(both, parts, {("",)})


def _spellings(parsed) -> set[tuple[str, ...]]:
    """Spellings of a parsed pattern."""
    out = []
    for op, arg in parsed:
        if op is C.LITERAL:
            out.append({(chr(arg),)})
        elif op is C.IN:
            chars = [chr(c) for kind, x in arg for c in ([x] if kind is C.LITERAL else range(x[0], x[1] + 1) if kind is C.RANGE and x[1] - x[0] < CLASS else range(CLASS + 1))]
            plain = len(chars) <= CLASS and all(kind in (C.LITERAL, C.RANGE) for kind, _ in arg)
            out.append({(c,) for c in chars} if plain else GAP)
        elif op is C.SUBPATTERN:
            out.append(_spellings(arg[-1]))
        elif op is C.ATOMIC_GROUP:
            out.append(_spellings(arg))
        elif op is C.BRANCH:
            out.append(set().union(*map(_spellings, arg[1])))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            least, most, inner = arg
            once = _spellings(inner)
            must = _joined([once] * min(least, COPIES))
            optional = least == 0 and most == 1
            out.append(once | {("",)} if optional else must if least == most <= COPIES else _joined([must, GAP]))
        elif op in (C.AT, C.ASSERT, C.ASSERT_NOT):
            out.append({("",)})
        else:
            out.append(GAP)
    return _joined(out)


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Clauses of lower-cased trigrams, of which any match has all of at least one; None where a match needs none.

    Clauses that hold a shorter one are left out.
    """
    clauses = set()
    for fragments in _spellings(_parser.parse(pattern)):
        said = [re.sub("[A-Z]", lambda m: m[0].lower(), f) for f in fragments]
        clauses.add(frozenset(f[i : i + 3] for f in said for i in range(len(f) - 2)))
    if frozenset() in clauses:
        return None
    return sorted((c for c in clauses if not any(o < c for o in clauses)), key=sorted)


def grams(text: Column, wanted: list[str] | None = None) -> Column:
    """The distinct trigrams of a text with A-Z lower-cased: those in ``wanted``, or all."""
    if wanted is None:
        pattern = r"(?s)(?=(.{3}))"
    else:
        heads = groupby(sorted(wanted), key=lambda g: g[0])
        pattern = "(?=(" + "|".join(re.escape(h) + "(?:" + "|".join(re.escape(g[1:]) for g in tails) + ")" for h, tails in heads) + "))"
    return F.array_distinct(F.regexp_extract_all(ascii_lower(text), F.lit(pattern), F.lit(1)))


def text_key(text: Column) -> Column:
    """What a text is known by in the index: half of its SHA-256, so that equal texts share their postings."""
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def build_index(docs: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """The stored postings (gram, key) of the texts, for the trigrams ``wanted`` or all; equal texts may repeat theirs."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select(text_key(text).alias("key"), grams(text, wanted).alias("_g"))
    return written(df.select("key", F.explode("_g").alias("gram")))


def candidates(index: DataFrame, queries: dict[str, list[frozenset[str]]]) -> DataFrame:
    """(kind, key) of the texts that have all trigrams of a clause, by intersecting their posting lists.

    The lists are intersected as bits: each trigram of a clause is one, and repeated postings change nothing.
    """
    said = [(kind, n, 1 << i, g, (1 << min(len(clause), 60)) - 1) for kind, clauses in sorted(queries.items()) for n, clause in enumerate(clauses) for i, g in enumerate(sorted(clause)[:60])]
    asked = index.sparkSession.createDataFrame(said, "kind string, clause int, bit bigint, gram string, need bigint")
    found = index.join(asked, "gram").groupBy("kind", "clause", "key", "need").agg(F.bit_or("bit").alias("bits"))
    return found.where("bits = need").select("kind", "key").distinct()


def marked(df: DataFrame, keys: DataFrame) -> DataFrame:
    """Adds ``maybe``: whether ``key`` may be among ``keys``, by a bitmap of ``PARTS * BITS`` bits."""
    h = lambda: F.xxhash64("key")
    part, bit = F.pmod(h(), F.lit(PARTS)), F.pmod(F.shiftright(h(), 10), F.lit(BITS)).cast("int")
    words = keys.select(part.alias("_part"), F.shiftright(bit, 6).alias("_word"), F.pmod(bit, F.lit(64)).alias("_at")).distinct()
    words = words.groupBy("_part", "_word").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("_at"))).alias("_bits"))
    maps = written(words.groupBy("_part").agg(F.map_from_entries(F.collect_list(F.struct("_word", "_bits"))).alias("_map")))
    out = df.withColumn("_in", part).join(F.broadcast(maps), F.col("_in") == F.col("_part"), "left")
    hit = F.getbit(F.coalesce(F.element_at("_map", F.shiftright(bit, 6)), F.lit(0).cast("bigint")), F.pmod(bit, F.lit(64))) == 1
    return out.select(*df.columns, F.when(F.col("_map").isNull(), F.lit(False)).otherwise(hit).alias("maybe"))


def _long_enough(rule: Rule):
    def test(s: Column) -> Column:
        return F.length(F.regexp_extract(s.match, rule.regex, rule.group) if rule.group else s.match) >= rule.least

    return test


def _ranked(spans: Column, rank: int) -> Column:
    """Spans as structs that sort by start, then by rule."""
    return F.transform(spans, lambda s: F.struct(s.start.alias("start"), F.lit(rank).alias("rank"), s.kind.alias("kind"), s.end.alias("end"), s.match.alias("match")))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds ``secrets``: array of (kind, start, end, match) by start, then by the order of ``rules``.

    Offsets count code points, the end is exclusive. A null or empty text has none; texts of any length are
    read whole; equal texts get equal results; an empty table gives no rows. A column ``secrets`` is
    replaced, all others stay, whatever their names.
    """
    rows, own = boxed(docs, ["text"], ["secrets"])
    queries = {r.kind: q for r in rules if (q := trigram_query(r.regex))}
    df = rows.withColumn("_t", F.coalesce("text", F.lit("")))
    if queries:
        wanted = sorted({g for clauses in queries.values() for clause in clauses for g in clause})
        found = candidates(build_index(rows, wanted), queries)
        df = marked(df.withColumn("key", text_key(F.col("_t"))), found.select("key"))
    parts = []
    for i, r in enumerate(rules):
        df = held(df, **{f"_s{i}": _found("_t", r.kind, r.regex, F.col("maybe") if r.kind in queries else F.lit(True))})
        parts.append(_ranked(F.filter(f"_s{i}", _long_enough(r)), i))
    both = F.transform(F.sort_array(F.concat(*parts)), lambda s: F.struct(s.kind.alias("kind"), s.start.alias("start"), s.end.alias("end"), s.match.alias("match"))).cast(SPAN)
    return df.withColumn("secrets", both).select(*own, "secrets")
