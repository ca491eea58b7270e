"""Quality classifier: Bradley-Terry ranking of documents from preference pairs.

Of each pair of labelled training documents with different labels, the better one is preferred. The
model ``P(a over b) = sigmoid(s(a) - s(b))`` is fitted by logistic loss on feature differences; features
are steps of the text statistics at quantiles, so ``s`` is additive. The decision cuts the scores at their
quantile over the training documents at the share of them that are labelled bad.

Quantiles, gradients and the cut are taken over all labelled training documents, and the loss over all their
pairs. No pair is formed for that: what a document adds to the gradient depends on its own score and on the
spread of the scores of the other label alone, so that a step is one pass that counts scores in bins and one
that sums what the documents add. Documents are stored as distinct places between the steps, with counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketloom.llm.common import forget, written
from ticketloom.llm.quality_rules import FEATURES, features, text_statistics

#: Steps of a feature for each label, the length of gradient steps and the weights' decay.
STEPS, RATE, DECAY, THRESHOLD = 8, 0.05, 1e-3, 0.3
#: Distinct places that the gradient steps start on, those steps, and the steps over all places. The loss is convex, so the start only saves steps.
START_ROWS, START_ROUNDS, ROUNDS = 4000, 300, 15
#: Scores are counted in ``BINS`` bins a unit between ``-REACH`` and ``REACH``; what documents add is summed as integers, in parts of ``UNIT``, so that their order doesn't matter.
BINS, REACH, UNIT = 64, 30, 1 << 20
#: Values of a feature are counted in bins of half a percent of the value plus a thousandth; scores at the cut in as many bins at a time.
VALUE_BINS, CUT_BINS = 200, 4096


@dataclass
class RankModel:
    """``terms``: (feature, cut, weight), each weight counted where the feature reaches the cut."""

    terms: list[tuple[str, float, float]]
    bias: float

    def score(self) -> Column:
        x, z = features(), F.lit(self.bias)
        for name, cut, weight in self.terms:
            z = z + F.when(x[name] >= cut, weight).otherwise(0.0)
        return F.round(1 / (1 + F.exp(-z)), 9)


class Labelled:
    """All labelled documents as a stored table of distinct places between the steps, with label and count; sums come back, never rows."""

    def __init__(self, rows: DataFrame, cuts: list[list[float]]):
        self.first = np.r_[0, np.cumsum([len(c) + 1 for c in cuts])]
        reached = lambda k, c: F.size(F.filter(F.array(*[F.lit(x) for x in c]), lambda x: x <= F.col(k))) if c else F.lit(0)
        at = F.array(*[(reached(k, c) + int(b)).cast("int") for k, c, b in zip(FEATURES, cuts, self.first, strict=False)])
        self.rows = written(rows.select("good", at.alias("at")).groupBy("good", "at").agg(F.count(F.lit(1)).alias("n")))
        self.start = self.rows.orderBy(F.xxhash64("good", "at"), "good", "at").limit(START_ROWS).toPandas()

    def levels(self, w: np.ndarray) -> np.ndarray:
        """What a place adds to a score: the weights of all steps of its feature up to it."""
        ends, out, done = self.first, [], 0
        for k in range(len(ends) - 1):
            n = ends[k + 1] - ends[k] - 1
            out.append(np.r_[0, np.cumsum(w[done : done + n])])
            done += n
        return np.concatenate(out)

    def by_step(self, at: np.ndarray) -> np.ndarray:
        """Sums by place as sums by step: a step counts for its own place and those after it."""
        ends = self.first
        return np.concatenate([np.cumsum(at[ends[k] : ends[k + 1]][::-1])[::-1][1:] for k in range(len(ends) - 1)])

    def _parts(self, level: np.ndarray, part: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], pd.DataFrame], schema: str, total: Callable[[pd.DataFrame], pd.DataFrame], start: bool = False) -> pd.DataFrame:
        """``total`` by key of what ``part(scores, good, counts, places)`` gives, over all rows or those of the start; each task hands on one row a key."""

        def of(b: pd.DataFrame, level: np.ndarray) -> pd.DataFrame:
            at, z = np.stack(b["at"].to_numpy()), np.zeros(len(b))
            for k in range(at.shape[1]):
                z += level[at[:, k]]
            return part(z, b["good"].to_numpy(bool), b["n"].to_numpy(), at)

        if start:
            return total(of(self.start, level))
        shared = self.rows.sparkSession.sparkContext.broadcast(level)

        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            forget()
            found = None
            for b in (b for b in batches if len(b)):
                new = of(b, shared.value)
                found = new if found is None else total(pd.concat([found, new]))
            if found is not None:
                yield found

        out = total(self.rows.mapInPandas(work, schema).toPandas())
        shared.unpersist()
        return out

    def spread(self, w: np.ndarray, start: bool = False) -> np.ndarray:
        """How many documents have a score of each bin: bad ones, then good ones."""

        def part(z: np.ndarray, good: np.ndarray, n: np.ndarray, _: np.ndarray) -> pd.DataFrame:
            key = good * (2 * REACH * BINS) + _binned(z)
            found = np.bincount(key, n)
            return pd.DataFrame({"key": np.flatnonzero(found), "n": found[found > 0].astype("int64")})

        got = self._parts(self.levels(w), part, "key bigint, n bigint", _sums, start)
        out = np.zeros(4 * REACH * BINS)
        out[got["key"].to_numpy(int)] = got["n"]
        return out.reshape(2, -1)

    def gradient(self, w: np.ndarray, start: bool = False) -> np.ndarray:
        """That of the mean loss over all pairs of a good and a bad document, by step."""
        bad, good = self.spread(w, start)
        if not bad.any() or not good.any():  # a start may lack a label
            return np.zeros(len(w))
        # For each bin, the mean over all scores of the other label of how far a pair is from being told right.
        used, width, places = np.flatnonzero(bad + good), len(bad), int(self.first[-1])
        here = slice(used[0], used[-1] + 1)
        m = used[-1] + 1 - used[0]
        wrong = 1 / (1 + np.exp(np.arange(1 - m, m) / BINS))
        pull = np.zeros((2, width))
        pull[0, here] = np.convolve(good[here], wrong[::-1])[m - 1 : 2 * m - 1] / good.sum()
        pull[1, here] = -np.convolve(bad[here], wrong)[m - 1 : 2 * m - 1] / bad.sum()
        pull = np.round(pull.ravel() * UNIT)

        def part(z: np.ndarray, good: np.ndarray, n: np.ndarray, at: np.ndarray) -> pd.DataFrame:
            by = pull[good * width + _binned(z)] * n
            found = sum(np.bincount(at[:, k] + places * good, by, 2 * places) for k in range(at.shape[1]))
            return pd.DataFrame({"key": np.arange(2 * places), "n": found.astype("int64")})

        got = self._parts(self.levels(w), part, "key bigint, n bigint", _sums, start)["n"].to_numpy(float)
        return self.by_step(got[:places] / bad.sum() + got[places:] / good.sum()) / UNIT

    def cut(self, w: np.ndarray, k: int) -> float:
        """Where the ``k`` lowest scores end: half-way between the scores on either side, or the score itself where both are equal."""
        level, low, high, before = self.levels(w), -float(np.abs(w).sum()) - 1, float(np.abs(w).sum()) + 1, 0
        below = None
        while True:

            def part(z: np.ndarray, _g: np.ndarray, n: np.ndarray, _a: np.ndarray, low: float = low, high: float = high) -> pd.DataFrame:
                here = (z >= low) & (z <= high)
                z, n = z[here], n[here]
                key = np.minimum((z - low) / (high - low) * CUT_BINS, CUT_BINS - 1).astype("int64")
                return _ends(pd.DataFrame({"key": key, "n": n, "least": z, "most": z}))

            got = self._parts(level, part, "key bigint, n bigint, least double, most double", _ends)
            upto = before + got["n"].cumsum().to_numpy()
            at = int(np.searchsorted(upto, k, side="right"))
            if at == len(got):  # all scores are among the lowest
                return float(got["most"].iloc[-1])
            first = before if at == 0 else int(upto[at - 1])
            below = below if at == 0 else float(got["most"].iloc[at - 1])
            least, most = float(got["least"].iloc[at]), float(got["most"].iloc[at])
            if first == k and below is not None:
                return (below + least) / 2
            if least == most or first == k:
                return least
            low, high, before = least, most, first


def _binned(z: np.ndarray) -> np.ndarray:
    return np.clip(np.floor((z + REACH) * BINS), 0, 2 * REACH * BINS - 1).astype("int64")


def _sums(parts: pd.DataFrame) -> pd.DataFrame:
    return parts.groupby("key", as_index=False).sum()


def _ends(parts: pd.DataFrame) -> pd.DataFrame:
    return parts.groupby("key", as_index=False).agg({"n": "sum", "least": "min", "most": "max"})


def labelled(stats: DataFrame, labels: DataFrame, where: Column | None = None) -> DataFrame:
    """good and the ``FEATURES`` of each labelled document in ``stats`` (doc_id and what ``text_statistics`` adds).

    Rows with a null id or label are left out; of several labels of one id the smallest counts, of several
    texts of one id the one with the smallest numbers, in the order of ``FEATURES``.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    if where is not None:
        known = known.where(where)
    known = known.groupBy("doc_id").agg(F.min("quality").cast("int").alias("_label"))
    rows = stats.select("doc_id", F.struct(*[c.alias(k) for k, c in features().items()]).alias("_x"))
    one = rows.join(known, "doc_id").groupBy("doc_id", "_label").agg(F.min("_x").alias("_x"))
    return one.select((F.col("_label") == 1).alias("good"), *[F.col(f"_x.{k}") for k in FEATURES])


def step_cuts(rows: DataFrame) -> list[list[float]]:
    """For each feature the values at ``STEPS`` quantiles of the good and of the bad rows, ascending.

    Values are counted in bins of a fixed number; a quantile is the smallest value in its bin.
    """
    each = rows.select("good", F.posexplode(F.array(*FEATURES)).alias("j", "x")).withColumn("bin", F.floor(F.log1p(1000 * F.col("x")) * VALUE_BINS))
    counts = each.groupBy("j", "bin").agg(F.min("x").alias("x"), F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")).toPandas().sort_values(["j", "bin"])
    out = []
    for j in range(len(FEATURES)):
        c, cuts = counts[counts["j"] == j], set()
        for label in ("good", "bad"):
            upto = c[label].cumsum().to_numpy()
            ranks = np.ceil(np.linspace(0.05, 0.95, STEPS) * upto[-1])
            cuts |= set(c["x"].to_numpy()[np.searchsorted(upto, np.maximum(ranks, 1))])
        out.append(sorted(float(x) for x in cuts))
    return out


def learn(rows: DataFrame) -> RankModel:
    """Fits weights by Adam steps on all pairs of ``rows`` (good and ``FEATURES``); with one label alone all scores are equal."""
    n = rows.agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")).first()
    if not n["good"] or not n["bad"]:
        return RankModel([], float(np.log(0.9 / 0.1)) if n["good"] else 0.0)
    cuts = step_cuts(rows)
    docs = Labelled(rows, cuts)
    w = np.zeros(sum(map(len, cuts)))
    m, v = np.zeros(len(w)), np.zeros(len(w))
    for t in range(1, START_ROUNDS + ROUNDS + 1):
        g = docs.gradient(w, t <= START_ROUNDS) + DECAY * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        # The last steps shrink, so that they end where the loss has them end.
        length = RATE if t <= START_ROUNDS else RATE * (1 - (t - START_ROUNDS) / (ROUNDS + 1))
        w -= length * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    w = np.round(w, 6)
    bias = float(np.log(THRESHOLD / (1 - THRESHOLD)) - docs.cut(w, n["bad"]))
    return RankModel([(name, c, float(x)) for (name, c), x in zip(((k, c) for k, of in zip(FEATURES, cuts, strict=True) for c in of), w, strict=True)], bias)


def fit(docs: DataFrame, labels: DataFrame, where: Column | None = None) -> RankModel:
    """Learns from all labelled documents. ``where`` restricts the labels that may be learned from."""
    return learn(written(labelled(text_statistics(docs.select("doc_id", "text")), labels, where)))


def scored(stats: DataFrame, model: RankModel) -> DataFrame:
    """Adds ``score`` and ``predicted`` to what ``text_statistics`` gives."""
    return stats.drop("score", "predicted").withColumn("score", model.score()).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def fit_and_score(docs: DataFrame, labels: DataFrame, where: Column | None = None) -> DataFrame:
    """doc_id, statistics, score and predicted of each row of ``docs`` (doc_id, text), by a model of its labelled ones; texts are read once."""
    stats = written(text_statistics(docs.select("doc_id", "text")).drop("text"))
    return scored(stats, learn(written(labelled(stats, labels, where))))


def score(docs: DataFrame, model: RankModel) -> DataFrame:
    """Adds ``score`` (0 to 1) and ``predicted`` (1 from ``THRESHOLD``) to the statistics.

    Null counts as an empty text; equal texts get equal scores; a score at the threshold counts as good; an
    empty table gives no rows. Columns named like an added one are replaced.
    """
    return scored(text_statistics(docs), model)
