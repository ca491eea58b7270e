"""The ten queries and the pipeline over whole small tables, against SQL or a brute-force version; ids and odd rows through all of them."""

import collections
import os
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm_operators import INNER, brute_spans, brute_statistics, check_places, sha

import corpus_pipeline
from ticketloom.llm import chat_format, decontaminate, near_dup, packing, pair_rank, pii_spans, quality_rules, queries, suffix_dedup, toxicity, url_filter

SF = "/root/testdata/sf0.001"
BIG = (1 << 53) + 1


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet").collect()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_against_sql(spark, duck, name):
    got, want = queries.QUERIES[name](spark, SF), duck.sql(queries.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.fetchall()))


def test_op2(spark):
    got = {r.page_id: r for r in queries.op2_url_filter(spark, SF).collect()}
    for r in table(spark, "pages"):
        _, there, rest = (r.url or "").partition("://")
        host = re.split("[/?#]", rest)[0] if there else ""
        path = re.split("[?#]", rest[len(host) :])[0] if there else ""
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fits = [x for x in url_filter.RULES if (host == x[0] or host.endswith("." + x[0])) and path.startswith(x[1])]
        best = max(fits, key=lambda x: len(x[0] + x[1]), default=None)
        x = got.pop(r.page_id)
        assert (x.host, x.path, x.rule) == (host, path, best and best[0] + best[1])
        assert x.verdict == (best[2] if best else "block" if x.score >= 0.5 else "allow")
    assert not got


#: URLs that no seed has, judged by hand: 1 is to be blocked.
JUDGED = [
    *[(u, 1) for u in ("http://cheap-pills-now.example.org/", "http://www.casino-royal.example.net/play", "https://xxx-videos.example.com/", "http://free-money-today.example.org/", "http://pharmacy-discount.example.net/", "http://spam-links.example.com/", "http://payday-loan-fast.example.org/", "http://warez-crack.example.net/")],
    *[(u, 0) for u in ("https://library-news.example.org/", "https://www.school-wiki.example.com/en/12", "https://museum.example.net/", "https://travel-blog.example.org/2021/", "https://docs-help.example.com/guide", "https://garden-recipes.example.net/", "https://weather-report.example.org/", "https://science-journal.example.com/")],
]


def test_url_model_on_urls_it_has_not_seen():
    w, b = url_filter.learn(url_filter.SEEDS)
    right = 0
    for url, y in JUDGED:
        assert all(url != seed for seed, _ in url_filter.SEEDS)
        k = url_filter._buckets(*url_filter.split_url(url))
        right += ((w[k].sum() / np.sqrt(len(k)) + b) > 0) == bool(y)
    assert right >= 14


#: Hosts of the pages table that a reader would block; no seed has the name of one.
BLOCKED = ("m.casino-win", "free-bets", "m.ads-track", "www.cheap-pills", "www.spam-farm", "blog.adult-x")


def test_no_seed_has_a_host_of_the_pages():
    names = [h.split(".")[-1] for h in BLOCKED]
    assert not [u for u, _ in url_filter.SEEDS if any(n in u for n in names)]


def test_labelled_urls_are_split_as_pages_are(spark):
    urls = ["http://A.example.COM", "http://a.example.com/", "https://É.example/x?y#z", "x://h?q/p", "h/no/scheme", "a://b://c/d", "", "http://h/" + "long/" * 20_000 + "?q"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    got = df.select(url_filter.host_of(F.col("url")), url_filter.path_of(F.col("url"))).collect()
    assert [tuple(r) for r in got] == [url_filter.split_url(u) for u in urls]
    assert url_filter.judge(df).count() == len(urls)


def test_url_model_on_the_hosts_of_the_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").where("url IS NOT NULL")
    bad = F.regexp_replace("host", r"\.example\.[a-z]+$", "").isin(*BLOCKED)
    got = url_filter.judge(pages.select("page_id", "url"), []).groupBy(bad.alias("bad"), F.col("verdict")).count().collect()
    n = {(r.bad, r.verdict): r["count"] for r in got}
    assert n[True, "block"] >= 0.9 * (n[True, "block"] + n.get((True, "allow"), 0)) and n.get((False, "block"), 0) <= 0.005 * n[False, "allow"]


def test_op3(spark):
    by = collections.defaultdict(list)
    for r in table(spark, "conversations"):
        by[r.conv_id].append((r.turn, r.role or "", r.text or ""))
    by[-7] = [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]
    got = {r.conv_id: r for r in queries.op3_chat_format(spark, SF).collect()}
    assert set(got) == set(by)
    for c, said in by.items():
        said.sort()
        answers = "".join(t for _, r, t in said if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(said), sha("".join(f"{r}\n{t}\n" for _, r, t in said)), len(answers), sha(answers))


def test_long_conversations_are_cut_into_blocks(spark):
    """Blocks of two budgets: all turns once, each answer a target once, windows led by the system turn and recent turns."""
    turns = [(1, k, "system" if not k else ("user", "assistant")[k % 2], f"t{k} " * (300 if k == 60 else 1 + k % 9)) for k in range(150)]
    df = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").repartition(3)
    windows = chat_format.format_chat(df, budget=100, history=2, span=2)
    rows = windows.orderBy("window").collect()
    assert len({r.window >> 32 for r in rows}) >= 7 and sum(r.n_turns for r in rows) == 150
    assert all(r.n_tokens <= 100 or r.over_budget for r in rows) and sum(r.over_budget for r in rows) == 1
    assert all(r.text.startswith("<|turn|>system<|text|>t0 <|end|>") for r in rows)
    seen = 0
    for r in rows:
        said = [int(t) for t in re.findall(r"<\|text\|>t(\d+) ", r.text)]
        own = said[r.n_repeated :]
        assert own == list(range(seen, seen + r.n_turns)) and (not seen or said[1 : r.n_repeated] == list(range(seen - r.n_repeated + 1, seen)))
        seen += r.n_turns
    got = chat_format.read_back(windows).first()
    assert (got.n_turns, got.turns_sha256) == (150, sha("".join(f"{r}\n{t}\n" for _, _, r, t in turns)))


def test_op4(spark):
    from tokenizers import Tokenizer

    encoder, want = Tokenizer.from_file(packing.vocabulary_path()), {}
    for r in table(spark, "documents"):
        ids = np.array([*encoder.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        for k in range(0, len(ids), 4096):
            want[r.doc_id, k // 4096] = (k, len(ids[k : k + 4096]), zlib.crc32(ids[k : k + 4096].tobytes()))
    rows = queries.op4_packing(spark, SF).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want
    bound = -(-sum(n for _, n, _ in want.values()) // 4096)
    assert check_places(rows) <= 1.02 * bound + 1


def test_op6(spark):
    got = {r.doc_id: r for r in queries.op6_quality_rules(spark, SF).collect()}
    for r in table(spark, "documents"):
        n, chars, symbols, lines, repeated = brute_statistics(r.text)
        x = got.pop(r.doc_id)
        failed = n < 20 or 100 * repeated > 30 * n
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) == (n, chars, symbols, lines, repeated, failed)
        assert not (failed and x.kept)
    assert not got


def test_learned_quality_rules_on_documents_held_out(spark):
    """Rules of half of the labels against the labels of the other half."""
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    half = F.crc32(F.col("doc_id").cast("string")) % 2
    rules = quality_rules.fit(docs, labels.where(half == 0))
    rows = quality_rules.apply_rules(docs.join(labels.where(half == 1), "doc_id"), rules).select("quality", "kept").collect()
    y, kept = np.array([r.quality == 1 for r in rows]), np.array([r.kept for r in rows])
    assert rules.rules and kept[y].mean() > 0.97 and (~kept[~y]).mean() > 0.9


@pytest.mark.parametrize("name, parts, out, least", [("op8_toxicity", 3, 1, 0.7), ("op10_quality_rank", 5, 0, 0.3)])
def test_op8_and_op10(spark, name, parts, out, least):
    rows = queries.QUERIES[name](spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in table(spark, "documents"))
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % parts == out) and 0 <= r.score <= 1 and r.predicted == (r.score >= least)


def test_op9(spark):
    got = {r.doc_id: r for r in queries.op9_pii(spark, SF).collect()}
    for r in table(spark, "documents"):
        base, x = brute_spans(r.text), got.pop(r.doc_id)
        assert (x.n_email, x.n_ip, x.n_card, x.n_phone) == tuple(sum(k == kind for k, _, _ in base) for kind in ("email", "ip", "card", "phone"))
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert x.base_sha256 == sha(said) and x.spans.startswith(said)
    assert not got


# --- ids above 2^53 next to null ones ---


def test_ids_are_exact(spark):
    ids = [BIG, None, BIG + 2, BIG + 1]
    texts = ["alpha beta gamma delta epsilon zeta", "ALPHA beta gamma delta epsilon zeta", "one two three four five six", None]
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id bigint, text string").coalesce(1)
    benchmark = spark.createDataFrame([(BIG + 4, "one two three")], "item_id bigint, text string")
    same = lambda df, c="doc_id": sorted((r[c] or 0) for r in df.collect()) == sorted((i or 0) for i in ids)
    found = decontaminate.contamination(docs, benchmark)
    assert same(found) and [r.doc_id for r in found.where("contaminated").collect()] == [BIG + 2] and found.where("contaminated").first().runs[0].item_id == BIG + 4
    near = near_dup.near_duplicates(docs)
    assert same(near) and {r.doc_id: r.component_id for r in near.collect()}[None] == BIG
    assert sorted(r.doc_id for r in near_dup.one_of_each(docs).collect()) == [BIG, BIG + 1, BIG + 2]
    assert same(packing.pack_documents(docs)) and same(suffix_dedup.remove_repeats(docs)) and same(pii_spans.find_all(docs)) and same(quality_rules.apply_rules(docs, quality_rules.DecisionList()))
    assert same(toxicity.score(docs, toxicity.ToxicityModel({}, 0.0))) and same(pair_rank.score(docs, pair_rank.RankModel([], 0.0)))
    assert same(url_filter.judge(docs.select("doc_id", F.col("text").alias("url"))))
    turns = docs.select(F.col("doc_id").alias("conv_id"), F.lit(0).cast("bigint").alias("turn"), F.lit("user").alias("role"), "text")
    windows = chat_format.format_chat(turns)
    assert same(windows, "conv_id") and same(chat_format.read_back(windows), "conv_id")


def test_repeats_above_2_53_are_cut_from_their_own_rows(spark):
    passage = "".join(np.random.default_rng(2).choice(list("abcdefgh "), 500))
    docs = spark.createDataFrame([(BIG, passage + "x"), (None, passage + "y"), (BIG + 1, "z" + passage[:300])], "doc_id bigint, text string").coalesce(1)
    got = suffix_dedup.remove_repeats(docs.withColumn("n_bytes", F.lit("own"))).collect()
    assert {r.doc_id: (r.n_removed, r.text) for r in got} == {BIG: (500, "x"), None: (500, "y"), BIG + 1: (0, "z" + passage[:300])}


# --- odd tables through all stages ---


def odd_documents(spark):
    rows = [(None, None), (1, None), (2, ""), (3, "   \n"), (4, "fine words " * 20000), (5, "same text here and there now"), (5, "same text here and there now"), (6, "Same text here and there now"), (None, "mail me@example.com please today"), (BIG, "plain"), (BIG + 1, "é😀 <|end|> [INST]")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: F.lit("own") for c in [*INNER, "lang", "source", "predicted", "n_words", "runs", "spans", "kept", "contaminated", "score", "made", "row", "n_hit", "has.dot"]})
    return df.withColumn("n_chars", F.lit(1).cast("bigint"))


def test_stages_on_odd_documents(spark):
    docs = odd_documents(spark)
    own = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, SF))
        assert docs.columns == odd_documents(spark).columns, name
        assert docs.where(" OR ".join(f"`{c}` IS DISTINCT FROM 'own'" for c in own)).count() == 0, name
    texts = collections.Counter((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    assert texts[(5, "same text here and there now")] == 1 and (6, "Same text here and there now") not in texts and texts[(None, "mail [EMAIL] please today")] == 1
    assert texts[(None, None)] == 1 and texts[(1, None)] == 1 and texts[(2, "")] == 1 and texts[(3, "   \n")] == 1 and texts[(BIG, "plain")] == 1
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_stages_on_empty_documents(spark):
    docs = odd_documents(spark).where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, SF))
        assert docs.count() == 0


def test_secrets_of_any_length_are_found(spark):
    long = "04dbebab91ab85687d33eeaaf9ac699e1188f962" * 25
    docs = spark.createDataFrame([(1, f'token = "{long}" end'), (2, f'key: "{long[:40]}" end')], "doc_id bigint, text string")
    model = pii_spans.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    assert {r.doc_id: [s.match for s in r.spans] for r in pii_spans.find(docs, model).collect()} == {1: [long], 2: [long[:40]]}
