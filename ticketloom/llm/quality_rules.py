"""Quality rules: text statistics and a learned decision list, as DataFrame expressions.

A decision list is learned by sequential covering: each rule is a conjunction of thresholds on the
statistics, grown condition by condition on one part of the labelled rows, pruned on the other part,
and the rows that it covers are removed before the next rule is sought. The rules come out as one
ordered conditional expression (``CASE WHEN ... THEN ...``), so that applying them is a scan without
a shuffle. Learning sees a bounded sample of labelled statistics; applying sees every row.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketloom.llm.common import boxed, held, labelled_sample, unboxed

BLANK = r"[\x20\x09-\x0D]+"
WINDOW = 8
#: Numbers that rules may test; each is a share or a mean, so that long and short texts compare.
FEATURES = ("n_words", "mean_word_chars", "symbol_share", "dup_line_share", "repeat_share", "unique_share", "exclaim_share", "upper_share", "bar_share", "digit_share")
#: Most labelled rows that learning collects.
SAMPLE_ROWS = 4000


def text_statistics(docs: DataFrame) -> DataFrame:
    """Adds word and line statistics of ``text`` to each row.

    A null or empty text has no words, and all its counts are 0. Repeated rows get equal numbers, an empty
    table gives no rows. Columns named like an added one, in any case, are replaced; all others stay.
    """
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_unique_words", "n_exclaim", "n_upper", "n_bars", "n_digits"]
    df, own = boxed(docs, ["text"], made)
    df = held(df, _t=F.coalesce(F.col("text"), F.lit("")))
    df = held(df, _w=F.array_remove(F.split("_t", BLANK), ""))
    df = held(df, _h=F.transform("_w", lambda x: F.xxhash64(x)), _lines=F.filter(F.split("_t", "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]"))))
    n = F.size("_w")
    grams = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(F.col("_h"), i + k) for k in range(WINDOW)])))
    df = held(df, _g=F.coalesce(grams, F.array().cast("array<bigint>")))
    # Only texts with some repeated window pay for sorting theirs.
    pairs = F.when(F.size(F.array_distinct("_g")) < F.size("_g"), F.sort_array(F.transform("_g", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    df = held(df, _p=F.coalesce(pairs, F.array().cast("array<struct<h:bigint,i:int>>")))
    twice = F.filter("_p", lambda p, i: F.coalesce(p.h == F.get(F.col("_p"), i - 1).h, F.lit(False)) | F.coalesce(p.h == F.get(F.col("_p"), i + 1).h, F.lit(False)))
    covered = F.aggregate(
        F.sort_array(F.transform(twice, lambda p: p.i)),
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("bigint").alias("words")),
        lambda a, i: F.struct(i.alias("last"), (a.words + F.least(F.lit(WINDOW), i - a.last)).alias("words")),
        lambda a: a.words,
    )
    count = lambda pattern: F.regexp_count("_t", F.lit(pattern)).cast("bigint")
    return unboxed(
        df,
        own,
        n_words=n.cast("bigint"),
        word_chars=F.length(F.regexp_replace("_t", BLANK, "")).cast("bigint"),
        n_symbols=count("[#*$%&|<>]"),
        n_dup_lines=(F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
        n_repeat_words=covered,
        n_lines=F.size("_lines").cast("bigint"),
        n_unique_words=F.size(F.array_distinct("_h")).cast("bigint"),
        n_exclaim=count("!"),
        n_upper=count(r"\p{Lu}"),
        n_bars=count(r"\|"),
        n_digits=count("[0-9]"),
    )


def features() -> dict[str, Column]:
    """The numbers of ``FEATURES`` from the columns of ``text_statistics``; 0 where there are no words."""
    share = lambda a, b: F.coalesce(F.col(a) / F.when(F.col(b) > 0, F.col(b)), F.lit(0.0))
    return {
        "n_words": F.col("n_words").cast("double"),
        "mean_word_chars": share("word_chars", "n_words"),
        "symbol_share": share("n_symbols", "word_chars"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "unique_share": share("n_unique_words", "n_words"),
        "exclaim_share": share("n_exclaim", "n_words"),
        "upper_share": share("n_upper", "word_chars"),
        "bar_share": share("n_bars", "n_words"),
        "digit_share": share("n_digits", "word_chars"),
    }


@dataclass
class DecisionList:
    """Ordered rules; the first whose conditions all hold decides ``reject``, else a row is kept."""

    rules: list[list[tuple[str, str, float]]] = field(default_factory=list)

    def verdict(self) -> Column:
        """The rules as one ordered conditional: true keeps the row."""
        x, out = features(), None
        for rule in self.rules:
            test = F.lit(True)
            for name, op, at in rule:
                test = test & (x[name] >= at if op == ">=" else x[name] < at)
            out = F.when(test, False) if out is None else out.when(test, False)
        return F.lit(True) if out is None else out.otherwise(True)


def _holds(x: np.ndarray, rule: list[tuple[int, str, float]]) -> np.ndarray:
    ok = np.ones(len(x), bool)
    for j, op, at in rule:
        ok &= x[:, j] >= at if op == ">=" else x[:, j] < at
    return ok


def _grow(x: np.ndarray, bad: np.ndarray, most: int = 4) -> list[tuple[int, str, float]]:
    """Adds the condition of the highest information gain until no good row is covered."""
    rule: list[tuple[int, str, float]] = []
    cover = np.ones(len(x), bool)
    while len(rule) < most and (cover & ~bad).any():
        p0, n0 = (cover & bad).sum(), (cover & ~bad).sum()
        base, best = np.log2(p0 / (p0 + n0)), (0.0, None, None)
        for j in range(x.shape[1]):
            cuts = np.unique(np.quantile(x[cover, j], np.linspace(0, 1, 41)))
            mids = np.unique(np.r_[cuts, (cuts[1:] + cuts[:-1]) / 2])
            for op in (">=", "<"):
                hit = cover[:, None] & (x[:, j, None] >= mids if op == ">=" else x[:, j, None] < mids)
                p, n = (hit & bad[:, None]).sum(0), (hit & ~bad[:, None]).sum(0)
                gain = np.where(p > 0, p * (np.log2(np.maximum(p, 1) / np.maximum(p + n, 1)) - base), 0)
                if gain.max() > best[0] + 1e-9:
                    k = int(gain.argmax())
                    best = (float(gain[k]), (j, op, float(mids[k])), hit[:, k])
        if best[1] is None:
            break
        rule.append(best[1])
        cover = best[2]
    return rule


def learn(x: np.ndarray, good: np.ndarray, names: tuple[str, ...] = FEATURES, most_rules: int = 12, least_precision: float = 0.9, seed: int = 7) -> DecisionList:
    """Sequential covering of the rows that aren't good. With one class alone there are no rules."""
    out, left = DecisionList(), np.ones(len(x), bool)
    part = np.random.default_rng(seed).random(len(x)) < 2 / 3
    while len(out.rules) < most_rules and (left & ~good & part).sum() >= 5:
        rule = _grow(x[left & part], ~good[left & part])
        held_x, held_bad = x[left & ~part], ~good[left & ~part]
        worth = lambda r: (lambda h: ((h & held_bad).sum() - (h & ~held_bad).sum()) / max(1, h.sum()))(_holds(held_x, r))
        while len(rule) > 1 and (shorter := max((rule[:k] + rule[k + 1 :] for k in range(len(rule))), key=worth)) and worth(shorter) >= worth(rule):
            rule = shorter
        hit = _holds(x, rule) & left
        if not rule or (hit & ~good).sum() < 5 or (hit & ~good).sum() < least_precision * hit.sum():
            break
        out.rules.append([(names[j], op, at) for j, op, at in rule])
        left &= ~hit
    return out


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DecisionList:
    """Learns a decision list from the statistics of at most ``sample_rows`` labelled documents."""
    sample = text_statistics(labelled_sample(docs, labels, "quality", sample_rows))
    rows = sample.select("doc_id", "label", *[c.alias(f"x_{k}") for k, c in features().items()]).collect()
    rows = sorted(rows, key=lambda r: r["doc_id"])
    if not rows:
        return DecisionList()
    x = np.array([[r[f"x_{k}"] for k in FEATURES] for r in rows])
    return learn(x, np.array([r["label"] == 1 for r in rows]))


def apply_rules(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """``text_statistics`` with base_failed (a fixed rule) and kept (neither it nor a learned rule rejects).

    Null and empty texts have no words and so fail; equal texts get equal verdicts; of rules that hold at
    once the first counts; an empty table gives no rows. Columns named like an added one are replaced.
    """
    df = text_statistics(docs).drop("base_failed", "kept")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return df.withColumn("base_failed", failed).withColumn("kept", ~failed & rules.verdict())
