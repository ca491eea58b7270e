"""URL filter: longest matching host and path rule, else logistic regression on hashed character n-grams.

The model is fitted with numpy on a small labelled URL table (``SEEDS`` unless another is given) and
rates each URL in Arrow batches; there is no shuffle.
"""

from __future__ import annotations

import re
import zlib
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketloom.llm.common import ascii_lower

BUCKETS, GRAMS = 1 << 14, (3, 4, 5)
_LOWER = str.maketrans(ascii_uppercase, ascii_lowercase)

#: A small labelled URL table, of words that the web's junk and other sites commonly have: 1 is to be blocked.
#: What goes before a host's name says nothing of it, so each host stands there with each of ``PREFIXES``.
PREFIXES = ("", "www.", "m.", "blog.")
SEEDS: list[tuple[str, int]] = [
    *[(f"http://{sub}{h}/", 1) for sub in PREFIXES for h in (
        "buy-pills-online.example.org", "discount-pharmacy.example.com", "online-casino.example.net", "casino-bonus.example.org", "slots-casino.example.com", "poker-room.example.com", "sports-betting.example.net", "adult-video.example.com", "adult-cams.example.org", "xxx-cams.example.net", "hot-singles.example.org", "spam-mail.example.com", "bulk-spam.example.net", "link-farm.example.net", "seo-links.example.org", "win-money-fast.example.com", "free-money.example.net", "free-prize.example.org", "get-rich-quick.example.com", "payday-loans.example.net", "cheap-loans.example.org", "cheap-meds.example.com", "replica-watches.example.com", "fake-bags.example.net", "cracked-warez.example.org", "torrent-warez.example.com", "keygen-crack.example.net", "lottery-winner.example.org", "crypto-double.example.com", "phish-login.example.net", "malware-drop.example.org", "clickbait-ads.example.com",
    )],
    *[(f"http://example.test/{p}", 1) for p in ("buy-pills", "casino/bonus", "adult/video", "xxx", "free-money", "win-prize", "warez/crack", "payday-loan", "spam")],
    *[(f"https://{sub}{h}/", 0) for sub in PREFIXES for h in (
        "example.net", "example.org", "example.com", "news.example.org", "docs.example.com", "shop.example.net", "forum.example.org", "wiki.example.com", "mail.example.net", "help.example.org", "support.example.com", "school.example.net", "library.example.org", "museum.example.com", "city-council.example.net", "university.example.org", "weather.example.com", "recipes.example.net", "history.example.org", "gardening.example.com", "science-today.example.net", "music-review.example.org", "travel-notes.example.com", "the-journal.example.net", "open-source.example.org", "health-service.example.com", "book-club.example.net", "theatre.example.org", "station.example.com", "mothering.example.net", "nation.example.org", "the-herald.example.com", "education.example.net", "weatherby.example.org", "northern-trains.example.com", "engineering.example.net",
    )],
    *[(f"https://www.example.test/{p}", 0) for p in ("en/1", "en/25", "en/873/", "de/7", "de/412.html", "fr/99", "fr/825", "es/533/", "es/10", "about", "contact", "article/12", "2020/05/post", "index.html", "docs/guide", "faq", "questions/44", "wiki/page", "archive/9")],
]

#: (host, path, verdict): a rule fits its host and all subdomains if the path starts with the rule's.
RULES: list[tuple[str, str, str]] = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, null where none does; of equal lengths the earlier one."""
    name = verdict = None
    for h, p, v in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        name = F.when(fits, h + p) if name is None else name.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    return (name, verdict) if rules else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def _buckets(host: str, path: str) -> np.ndarray:
    out = set()
    for mark, part in (("h", f"^{host}$"), ("p", f"{path}$")):
        for n in GRAMS:
            out.update(zlib.crc32(f"{mark}{part[i : i + n]}".encode()) % BUCKETS for i in range(len(part) - n + 1))
    return np.fromiter(out, int, len(out))


def split_url(url: str) -> tuple[str, str]:
    """Host and path of a labelled URL, as ``host_of`` and ``path_of`` give them."""
    found = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url)
    return (found[1].translate(_LOWER), found[2]) if found else ("", "")


def learn(seeds: list[tuple[str, int]], steps: int = 2000, rate: float = 1.0, decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """Weights by gradient descent on the mean logistic loss; each URL's n-grams are scaled to length 1."""
    rows = [_buckets(*split_url(u)) for u, _ in seeds]
    y = np.array([v for _, v in seeds], float)
    i = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    j = np.concatenate(rows)
    x = 1 / np.sqrt(np.repeat([len(r) for r in rows], [len(r) for r in rows]))
    w, b = np.zeros(BUCKETS), 0.0
    for _ in range(steps):
        g = 1 / (1 + np.exp(-(np.bincount(i, x * w[j], len(rows)) + b))) - y
        w -= rate * (np.bincount(j, x * g[i], BUCKETS) / len(rows) * 20 + decay * w)
        b -= rate * g.mean()
    return w, float(b)


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] | None = None, seeds: list[tuple[str, int]] | None = None, block_from: float = 0.5) -> DataFrame:
    """Adds host, path, rule, score and verdict to each row with a ``url``.

    A null or empty URL, or one without ``://``, has an empty host and path; the model judges those too.
    Repeated rows are judged alike, of rules of equal length the earlier one counts, and an empty table
    gives no rows. Columns named like an added one are replaced; all others stay.
    """
    shared = pages.sparkSession.sparkContext.broadcast(learn(SEEDS if seeds is None else seeds))

    # Only hosts and paths go to Python. A filter on the score mustn't compute it once more.
    @F.pandas_udf("double")
    def rate(hosts: pd.Series, paths: pd.Series) -> pd.Series:
        w, b = shared.value
        z = [w[k].sum() / np.sqrt(max(1, len(k))) + b for k in map(_buckets, hosts, paths)]
        return pd.Series(np.round(1 / (1 + np.exp(-np.array(z, float))), 9))

    df = pages.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))}).withColumn("score", rate.asNondeterministic()("host", "path"))
    name, verdict = longest_rule(F.col("host"), F.col("path"), RULES if rules is None else rules)
    verdict = F.coalesce(verdict, F.when(F.col("score") >= block_from, "block").otherwise("allow"))
    # In the order of the caller's other columns, then the added ones.
    added = {"host": F.col("host"), "path": F.col("path"), "score": F.col("score"), "rule": name, "verdict": verdict}
    kept = [F.col("`" + c.replace("`", "``") + "`") for c in pages.columns if c.lower() not in added]
    return df.select(*kept, *[c.alias(n) for n, c in added.items()])
