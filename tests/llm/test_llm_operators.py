"""Each training-data operator against a brute-force version, and its defined results for odd rows."""

import os
import collections
import hashlib
import re
import sys
import weakref
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketloom.llm import chat_format, common, decontaminate, near_dup, packing, pair_rank, pii_spans, quality_rules, suffix_dedup, toxicity, url_filter

SF = "/root/testdata/sf0.001"
ODD = "doc_id bigint, text string, n_words string, spans string, score string, kept string"


#: Names that operators use inside; as columns of the caller they mustn't matter.
INNER = "th _h _c _id doc h pos next item w i run start end _t _w _g _p _lines _email _ip _card _phone _contact _secret _more _o _r _rank _salt _lead _lead_th _th _d class label n rep _items _z z score_ cut x".split()


def rows_of(spark, *texts):
    """Texts as rows with columns whose names clash with what operators add and with what they use inside."""
    df = spark.createDataFrame([(i, t, "x", "x", "x", "x") for i, t in enumerate(texts)], ODD)
    return df.withColumns({c: F.lit("own") for c in INNER})


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- 1: decontamination ---


def brute_hits(text, items, window=10):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hit, found = set(), set()
    for item, said in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), said or ""))
        k = min(window, len(w))
        for s in range(len(w) - k + 1) if w else ():
            for i in range(len(words) - k + 1):
                if words[i : i + k] == w[s : s + k]:
                    hit.update(range(i, i + k))
                    found.add(item)
    return len(words), len(hit), sorted(map(str, found))


def test_decontamination(spark):
    passage = "one two three four five six seven eight nine ten eleven twelve"
    items = [(1, passage), (2, "Solo"), (3, "short ITEM"), (4, None), (5, ""), (10, "the the the the the the the the the the the"), (1, passage), (None, "lost item")]
    texts = [f"Intro, {passage}! end", "one two three four five six seven eight nine", None, "", "solo SOLO x", "a short item here; short item", "the " * 30, "é " * 5000 + passage, f"{passage} {passage}", f"{passage} {passage}", "lost item"]
    docs = rows_of(spark, *texts)
    got = {r.doc_id: r for r in decontaminate.contamination(docs, spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        n, hit, found = brute_hits(t, items)
        found = [x for x in found if x != "None"]
        assert (got[i].n_words, got[i].n_hit, got[i].n_items, got[i].items_sha256, got[i].contaminated) == (n, hit, len(found), sha(",".join(found)), hit > 0), t
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert not any(r.contaminated for r in decontaminate.contamination(docs, none).collect())
    assert decontaminate.contamination(docs.where("false"), none).count() == 0


def test_items_that_repeat_words(spark):
    """Items of one word, of a short period and with windows that come back, in documents that repeat them."""
    items = [(1, "a " * 40), (2, "a b c " * 12), (3, "x y z p q r s t u v w x y z p q r s t u v w k"), (None, "lost " * 15)]
    texts = ["a " * 55, "c a b " * 9, "x y z p q r s t u v w k", "lost " * 12 + "a " * 9, "b a " * 30, "u v w x y z p q r s t u v w k " * 2]
    got = {r.doc_id: r for r in decontaminate.contamination(rows_of(spark, *texts), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    for i, t in enumerate(texts):
        n, hit, found = brute_hits(t, items)
        found = [x for x in found if x != "None"]
        assert (got[i].n_words, got[i].n_hit, got[i].n_items, got[i].items_sha256, got[i].contaminated) == (n, hit, len(found), sha(",".join(found)), hit > 0), t


def test_long_texts_of_one_word(spark):
    """A document of 8,000 equal words against an item of 2,000: as many lookups as words."""
    docs = spark.createDataFrame([(1, "so " * 8000), (2, "so " * 9)], "doc_id bigint, text string")
    got = {r.doc_id: r.n_hit for r in decontaminate.contamination(docs, spark.createDataFrame([(7, "so " * 2000)], "item_id bigint, text string")).collect()}
    items = decontaminate.benchmark_items(spark.createDataFrame([(7, "so " * 2000)], "item_id bigint, text string")).first()
    assert got == {1: 8000, 2: 0} and items.starts == [0] and len(items.asked) == 10


def test_repeated_ids_keep_their_own_hits(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (1, "gamma"), (None, "alpha beta"), (1, "alpha beta")], "doc_id bigint, text string")
    got = decontaminate.contamination(docs, spark.createDataFrame([(7, "alpha beta")], "item_id bigint, text string"))
    assert sorted((r.doc_id or -1, r.text, r.n_hit) for r in got.collect()) == [(-1, "alpha beta", 2), (1, "alpha beta", 2), (1, "alpha beta", 2), (1, "gamma", 0)]


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "red x x blue"), (2, "blue red"), (3, "red x x x x x blue")], "doc_id bigint, text string")
    terms = spark.createDataFrame([(9, "red"), (9, "blue")], "query_id bigint, w string").select("query_id", F.xxhash64("w").alias("h"))
    index = decontaminate.build_index(docs, terms.select("h").distinct())
    assert sorted((r.doc, r.start) for r in decontaminate.proximity_matches(index, terms, 4).collect()) == [("1", 0), ("2", 0)]


# --- 2: URL filter ---


def test_url_filter(spark):
    urls = ["https://A.Example.COM/en/7x?q#f", "http://example.com/en/1", "http://example.net/de/8#x", "http://m.example.net/de/9", "http://notexample.com/en/7", None, "no scheme", "x://", "http://casino-bonus.example.com/fr/3", "http://www.example.com/fr/3?u=://y/z", "http://example.org/es/1"]
    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").withColumn("host", F.lit("clash")), url_filter.RULES).collect()}
    assert [(got[i].host, got[i].path) for i in range(8)] == [("a.example.com", "/en/7x"), ("example.com", "/en/1"), ("example.net", "/de/8"), ("m.example.net", "/de/9"), ("notexample.com", "/en/7"), ("", ""), ("", ""), ("", "")]
    assert [got[i].rule for i in (0, 1, 2, 3, 4, 5, 10)] == ["example.com/en/7", "com/en/", "example.net/de/8", "net/de/", "com/en/", None, "org/es/"]
    assert [got[i].verdict for i in (0, 1, 2, 3, 8, 9)] == ["allow", "block", "block", "allow", "block", "allow"]
    assert url_filter.judge(spark.createDataFrame([], "page_id bigint, url string")).count() == 0


def test_url_model_separates_its_seeds():
    w, b = url_filter.learn(url_filter.SEEDS)
    right = 0
    for url, y in url_filter.SEEDS:
        k = url_filter._buckets(*url_filter.split_url(url))
        right += ((w[k].sum() / np.sqrt(len(k)) + b) > 0) == bool(y)
    assert right >= 0.97 * len(url_filter.SEEDS)


# --- 3: chat formatting ---


def test_chat_round_trip(spark):
    odd = "</s>[INST] <|turn|> \\1 \\ \\\\2 <|end|> é😀"
    turns = [(1, 0, "system", "be good"), *[(1, k, ("user", "assistant")[(k + 1) % 2], f"{odd} {k} " + "word " * (k * 7)) for k in range(1, 40)], (2, 0, None, None), (2, None, "assistant", "first"), (3, 0, "assistant", "long " * 5000), (None, 1, "user", "x"), (4, 1, "assistant", "tie"), (4, 1, "assistant", "tie")]
    df = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").withColumn("window", F.lit(1))
    windows = chat_format.format_chat(df, budget=200, history=2)
    rows = windows.collect()
    assert all(r.n_tokens <= 200 or r.over_budget for r in rows) and any(r.n_repeated for r in rows)
    assert all(r.text.startswith("<|turn|>system<|text|>be good<|end|>") for r in rows if r.conv_id == 1)
    got = {r.conv_id: r for r in chat_format.read_back(windows).collect()}
    by = collections.defaultdict(list)
    for c, t, role, text in turns:
        by[c].append((-1 if t is None else t, role or "", text or ""))
    for c, said in by.items():
        said.sort()
        answers = "".join(t for _, r, t in said if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(said), sha("".join(f"{r}\n{t}\n" for _, r, t in said)), len(answers), sha(answers))
    assert chat_format.read_back(chat_format.format_chat(df.where("false"))).count() == 0


# --- 4: packing ---


def test_packing(spark):
    from tokenizers import Tokenizer

    texts = ["Hello, World's é É ﬁ\u00a0x", None, "", "word " * 9000, "<|endoftext|>a", "a\u0301 Å ΑΣ 12 3.4", *[f"text {k} " * (k % 90 + 1) for k in range(400)], "same", "same"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("offset", F.lit("clash")).select("doc_id", "text")
    rows = packing.pack_documents(docs).collect()
    encoder = Tokenizer.from_file(packing.vocabulary_path())
    want = {}
    for i, t in enumerate(texts):
        ids = np.array([*encoder.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for k in range(0, len(ids), 4096):
            want[i, k // 4096] = (k, len(ids[k : k + 4096]), zlib.crc32(ids[k : k + 4096].tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want
    check_places(rows)
    assert packing.pack_documents(docs.where("false")).count() == 0


def test_a_packing_worker_holds_a_bounded_cache_and_one_batch():
    from tokenizers import Tokenizer

    class Docs:  # stands for a DataFrame, so that the workers' function runs here
        schema = T.StructType([T.StructField("text", T.StringType())])
        drop = lambda self, *names: self
        mapInArrow = lambda self, f, schema: f

    letters = ["".join(chr(97 + k // 26**i % 26) for i in range(4)) for k in range(310_000)]
    texts = [" ".join(letters[k : k + 1000]) for k in range(0, len(letters), 1000)]
    texts += ["z" * 3000 + "! " + " ".join(x.capitalize() + "," for x in letters[:50]), None]
    alive = []

    def batches():
        for k in range(0, len(texts), 100):
            assert not any(x() is not None for x in alive)
            b = pa.RecordBatch.from_pydict({"text": pa.array(texts[k : k + 100], pa.string())})
            alive.append(weakref.ref(b))
            yield b
            del b

    common.forget()
    rows = [r for out in packing.tokenized(Docs())(batches()) for r in out.select(["length", "ids_crc32"]).to_pylist()]
    known = sys.modules["ticketloom_worker"].ids[None]
    assert len(known) <= 300_000 and max(map(len, known)) <= 64
    common.forget()
    encoder = Tokenizer.from_file(packing.vocabulary_path())
    for text, r in [*zip(texts, rows, strict=True)][-6:]:
        ids = np.array([*encoder.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        assert r == {"length": len(ids), "ids_crc32": zlib.crc32(ids.tobytes())}


def test_packing_leaves_the_session_as_it_was(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, "77")
    try:
        assert packing.pack_documents(spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")).count() == 1
        assert spark.conf.get(key) == "77" and spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None
        with pytest.raises(ValueError), common.settings(spark, packing.BATCH):
            assert spark.conf.get(key) == "1000"
            raise ValueError
        assert spark.conf.get(key) == "77"
    finally:
        spark.conf.unset(key)


def check_places(rows):
    places = collections.defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 4096
    return len(places)


@pytest.mark.parametrize("seed", range(4))
def test_plan_is_close_to_the_bound(seed):
    rng = np.random.default_rng(seed)
    lengths = np.minimum(4096, rng.lognormal(6, 1.2, 5000).astype(int) + 2)
    histogram = {int(k): int(n) for k, n in zip(*np.unique(lengths, return_counts=True), strict=True)}
    runs = packing.best_plan(histogram)
    used = collections.Counter()
    for k, rank, n, _, _ in runs:
        assert rank == used[k]
        used[k] += n
    assert used == histogram
    assert max(r[3] + r[2] for r in runs) <= 1.01 * -(-int(lengths.sum()) // 4096) + 2


def test_nnls_finds_a_known_solution():
    rng = np.random.default_rng(1)
    a, x = rng.random((30, 12)), np.maximum(0, rng.normal(size=12))
    assert np.allclose(packing.nnls(a, a @ x), x, atol=1e-6)


# --- 5: near copies ---


def brute_components(texts, percent=75):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return [(len(s), root(i)) for i, s in enumerate(sets)]


def near_copies(seed=3, groups=12, size=9):
    rng = np.random.default_rng(seed)
    shared = [f"c{k}" for k in range(60)]  # a passage that half of the groups have
    out = ["", None, "   \n", "one", "ONE", "one two", "a b c d e", "A b c d e", "x" * 5000]
    for g in range(groups):
        base = [f"w{g}_{k}" for k in range(int(rng.integers(8, 120)))] + (shared if g % 2 else [])
        for _ in range(size):
            words = list(base)
            for k in rng.choice(len(words), int(rng.integers(0, max(1, len(words) // 18 + 1))), replace=False):
                words[k] = f"n{rng.integers(1 << 30)}"
            out.append(" ".join(words))
    return [*out, out[-1], out[-1]]


@pytest.mark.parametrize("seed", [3, 4])
def test_near_duplicates(spark, seed):
    texts = near_copies(seed)
    got = {r.doc_id: r for r in near_dup.near_duplicates(rows_of(spark, *texts)).collect()}
    for i, (n, low) in enumerate(brute_components(texts)):
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (n, low, i == low), texts[i]
    assert near_dup.near_duplicates(rows_of(spark, "x").where("false")).count() == 0


def test_one_row_of_each_group_stays(spark):
    docs = spark.createDataFrame([(2, "a b c d e f"), (2, "a b c d e f"), (1, "A b c d e f"), (None, "a b c d e f"), (3, ""), (4, None), (5, "z")], "doc_id bigint, text string")
    assert sorted((r.doc_id, r.text or "") for r in near_dup.one_of_each(docs).collect()) == [(1, "A b c d e f"), (3, ""), (4, ""), (5, "z")]


def test_rare_shingle_join_is_exact(spark):
    """Many sets near the threshold, all with one passage: the join on rare shingles gives the links of all pairs."""
    rng = np.random.default_rng(8)
    base = list(rng.integers(1, 1 << 62, 100))
    sets = []
    for _ in range(120):
        s = list(base)
        for k in rng.choice(100, int(rng.integers(5, 30)), replace=False):
            s[k] = int(rng.integers(1, 1 << 62))
        sets.append(sorted({int(v) for v in s}))
    cls = [bytes([k]) for k in range(len(sets))]
    data = [(c, s, near_dup.bitmap(np.array(s, np.uint64)).tolist()) for c, s in zip(cls, sets, strict=True)]
    table = spark.createDataFrame(data, "class binary, set array<bigint>, bits array<bigint>")
    left = table.select("class", F.col("class").alias("label"))
    links = near_dup._by_rare_shingles(left, table.select("class"), lambda _: table, 75)
    labels = {bytes(r["class"]): bytes(r.label) for r in near_dup.components(left, links).collect()}
    parent = dict(zip(cls, cls, strict=True))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(set(a) & set(sets[j]))
            if 100 * both >= 75 * (len(a) + len(sets[j]) - both):
                x, y = sorted((root(cls[i]), root(cls[j])))
                parent[y] = x
    assert labels == {c: root(c) for c in cls}


def test_rare_shingle_join_keeps_merged_classes_in_later_rounds(spark, monkeypatch):
    """A first round links the first set with the last but one; many rounds later that one still links with the last."""
    monkeypatch.setattr(near_dup, "CENTRES", 1)
    rng = np.random.default_rng(5)
    words = rng.permutation(rng.integers(1, 1 << 62, 170))
    sets = [words[:100], *[rng.choice(words, 100, replace=False) for _ in range(150)], words[9:109], words[18:118]]
    cls = [bytes([k]) for k in range(len(sets))]
    data = [(c, sorted(s.tolist()), near_dup.bitmap(np.sort(s).astype(np.uint64)).tolist()) for c, s in zip(cls, sets, strict=True)]
    table = spark.createDataFrame(data, "class binary, set array<bigint>, bits array<bigint>")
    left = table.select("class", F.col("class").alias("label"))
    links = near_dup._by_rare_shingles(left, table.select("class"), lambda _: table, 75)
    want = {(i, j) for j, b in enumerate(sets) for i, a in enumerate(sets[:j]) if 7 * len(set(a.tolist()) & set(b.tolist())) >= 6 * 100}
    assert want == {(0, 151), (151, 152)}
    assert {tuple(sorted((r.a[0], r.b[0]))) for r in links.collect()} == want


# --- 6: quality rules ---


def brute_statistics(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    grams = collections.defaultdict(list)
    for i in range(len(w) - 7):
        grams[tuple(w[i : i + 8])].append(i)
    covered = {k for at in grams.values() if len(at) > 1 for i in at for k in range(i, i + 8)}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark):
    texts = [None, "", " \t\n", "a b", "a " * 40, "x y z\nx y z\n\nq", "é😀 #$ " * 30, " ".join(f"w{k % 9}" for k in range(50)), " ".join(f"w{k}" for k in range(3000)), "w1 " * 20001]
    texts += [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(40).collect()]
    learned = quality_rules.DecisionList([[("symbol_share", ">=", 0.2), ("n_words", ">=", 1.0)]])
    got = {r.doc_id: r for r in quality_rules.apply_rules(rows_of(spark, *texts), learned).collect()}
    for i, t in enumerate(texts):
        n, chars, symbols, lines, repeated = brute_statistics(t)
        failed = n < 20 or 100 * repeated > 30 * n
        assert (got[i].n_words, got[i].word_chars, got[i].n_symbols, got[i].n_dup_lines, got[i].n_repeat_words, got[i].base_failed) == (n, chars, symbols, lines, repeated, failed), t
        assert got[i].kept == (not failed and not (n and symbols / chars >= 0.2))


def test_decision_list_is_learned():
    rng = np.random.default_rng(2)
    x = rng.random((1500, 10))
    good = ~((x[:, 2] >= 0.8) | ((x[:, 6] >= 0.7) & (x[:, 7] >= 0.6)))
    rules = quality_rules.learn(x, good)
    rejected = np.zeros(len(x), bool)
    for rule in rules.rules:
        rejected |= quality_rules._holds(x, [(quality_rules.FEATURES.index(n), op, at) for n, op, at in rule])
    assert (rejected == ~good).mean() > 0.96
    assert quality_rules.learn(x, np.ones(len(x), bool)).rules == []


# --- 7: repeated strings ---


def brute_removed(texts, length=400):
    starts = collections.Counter()
    data = [(t or "").encode() for t in texts]
    for b in data:
        starts.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if starts[b[i : i + length]] > 1:
                gone[i : i + length] = True
        left = bytes(np.frombuffer(b, np.uint8)[~gone[:-1]])
        out.append((len(b), int(gone.sum()), int((np.diff(np.r_[False, gone].astype(int)) == 1).sum()), hashlib.sha256(left).hexdigest()))
    return out


@pytest.mark.parametrize("most", [4000, 2])
def test_suffix_dedup(spark, most, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "MOST", most)
    rng = np.random.default_rng(6)
    say = lambda n: "".join(rng.choice(list("abcdefgh ij\né"), n))
    passage, line = say(700), say(120)
    texts = [None, "", "a" * 399, "b" * 400, "c" * 401, "ab" * 600, say(900), passage + say(300), say(250) + passage[100:650], say(50) + passage[5:404] + say(9), passage[:401], passage[299:], *[say(300) + line + say(300) for _ in range(6)]]
    texts += [passage[:350] + "X" + passage[351:], say(2000), "same text " * 50, "same text " * 50, say(500) + passage + say(500) + passage]
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(rows_of(spark, *texts)).collect()}
    for i, want in enumerate(brute_removed(texts)):
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == want, i
    assert suffix_dedup.remove_repeats(rows_of(spark, "x").where("false")).count() == 0


def test_buckets_stay_whole_where_a_join_becomes_a_broadcast(spark, tmp_path):
    """Both rows of a bucket are compared also where large buckets are taken out by a join that Spark, at run time, reads by other parts than its keys."""
    rng = np.random.default_rng(8)
    rows = [(b"big", b"big%d" % i, rng.bytes(5000)) for i in range(9)]
    for k in range(40):
        shared = rng.bytes(420)
        rows += [(b"k%d" % k, b"%d.%d" % (k, i), rng.bytes(30) + shared + rng.bytes(5000)) for i in range(2)]
    made = spark.createDataFrame(rows, "key binary, class binary, bytes binary").selectExpr("key", "0 AS node_lo", "360 AS node_hi", "class", "0 AS lo", "100 AS hi", "bytes")
    made.repartition(4).write.parquet(f"{tmp_path}/rows")
    rows = spark.read.parquet(f"{tmp_path}/rows")
    big = rows.groupBy("key").count().where("count > 4").select("key")
    # More than the keys' counts take, less than Spark expects of them.
    confs = {"spark.sql.autoBroadcastJoinThreshold": "20k", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in confs}
    try:
        for k, v in confs.items():
            spark.conf.set(k, v)
        got = suffix_dedup._refined(rows.join(big, "key", "left_anti")).collect()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert sorted((bytes(r["class"]), r["from"], r["to"]) for r in got) == sorted((b"%d.%d" % (k, i), -70, 350) for k in range(40) for i in range(2))


def test_long_texts_in_blocks(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK", 1000)
    data = np.random.default_rng(1).integers(97, 101, 7000).astype(np.uint8).tobytes()
    windows = [w for a, first, last, _ in suffix_dedup.anchors(data, suffix_dedup._byte_values()) for w in range(first, last + 1) if first <= a <= first + 360]
    assert windows == list(range(len(data) - 399))


# --- 8 and 10: classifiers ---


def held_out(spark, score, fit, label, parts, out):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    fold = F.crc32(F.col("doc_id").cast("string")) % parts
    model = fit(docs, labels, fold != out)
    rows = score(docs.join(labels, "doc_id").where(fold == out), model).select(label, "predicted", "score").collect()
    y, p, s = (np.array([r[c] for r in rows]) for c in (label, "predicted", "score"))
    assert s.min() >= 0 and s.max() <= 1
    return y, p


def test_toxicity_held_out(spark):
    y, p = held_out(spark, toxicity.score, toxicity.fit, "toxic", 3, 1)
    assert (p[y == 1] == 1).mean() > 0.75 and (p[y == 0] == 0).mean() > 0.98


def test_quality_rank_held_out(spark):
    y, p = held_out(spark, pair_rank.score, pair_rank.fit, "quality", 5, 0)
    assert (p == y).mean() > 0.97


def test_near_copies_leave_few_files(spark, tmp_path, monkeypatch):
    """On a small table with many shuffle partitions, rounds hand on few files, and tables that nothing reads any more are gone."""
    texts = [" ".join(f"w{g}x{k}" for k in range(60)) + f" end{i}" for g in range(6) for i in range(6)]
    before, base = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}, tmp_path
    monkeypatch.setattr("ticketloom.llm.common.shared_dir", lambda spark: f"file://{base}/{len(os.listdir(base))}-{os.urandom(4).hex()}")
    try:
        for k, v in zip(before, ("40", "false"), strict=True):
            spark.conf.set(k, v)
        got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(rows_of(spark, *texts)).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    low = min(got)
    assert got == {low + i: low + i // 6 * 6 for i in range(36)}
    tables = [[f for f in os.listdir(d) if f.endswith(".parquet")] for d in tmp_path.iterdir()]
    assert len([t for t in tables if t]) <= 16 and sorted(map(len, tables))[len(tables) // 2] <= 8


def test_quality_rank_learns_from_all_labels(spark):
    """Quantiles, gradients and the cut come from all of 5,000 labelled rows, and gradients from all their pairs."""
    n, rng = 5000, np.random.default_rng(3)
    x, good = rng.integers(0, 40, n), rng.random(n) < 0.6
    docs = spark.createDataFrame([(i, "word " * int(k + 10 * g)) for i, (k, g) in enumerate(zip(x, good, strict=True))], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(g)) for i, g in enumerate(good)], "doc_id bigint, quality int")
    rows = pair_rank.labelled(quality_rules.text_statistics(docs), labels)
    cuts = pair_rank.step_cuts(rows)
    words = x + 10 * good
    assert {float(np.sort(words[good == g])[int(np.ceil(q * (good == g).sum())) - 1]) for g in (True, False) for q in np.linspace(0.05, 0.95, 8)} == set(cuts[0])
    table, w = pair_rank.Labelled(rows, cuts), rng.normal(0, 1, sum(map(len, cuts)))
    all_steps = rows.select("good", *pair_rank.FEATURES).toPandas()
    phi = np.column_stack([all_steps[k] >= c for k, of in zip(pair_rank.FEATURES, cuts, strict=True) for c in of]).astype(float)
    s, g = phi @ w, all_steps["good"].to_numpy()
    wrong = 1 / (1 + np.exp(s[g][:, None] - s[~g][None, :]))
    assert table.spread(w).sum() == n
    assert np.abs(table.gradient(w) - (phi[~g].T @ wrong.mean(0) / (~g).sum() - phi[g].T @ wrong.mean(1) / g.sum())).max() < 0.01
    for k in (int((~g).sum()), 1, n):
        order = np.sort(s)
        below, at = order[k - 1], order[min(k, n - 1)]
        assert abs(table.cut(w, k) - ((below + at) / 2 if at - below > 1e-9 else at)) < 1e-9


def test_classifiers_on_odd_tables(spark):
    docs = rows_of(spark, None, "", "fine words here", "long " * 20000)
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    nulls = spark.createDataFrame([(None, 1, 1), (1, None, None), (2, 1, 1), (2, 0, 0), (99, 1, 1)], "doc_id bigint, quality int, toxic int")
    for labels in (none, nulls):
        for module in (toxicity, pair_rank):
            rows = module.score(docs, module.fit(docs, labels)).collect()
            assert len(rows) == 4 and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in rows)
        assert quality_rules.apply_rules(docs, quality_rules.fit(docs, labels)).count() == 4
    assert toxicity.score(docs.where("false"), toxicity.fit(docs.where("false"), none)).count() == 0


def test_positive_unlabelled_risk_finds_the_marker():
    say = lambda bad: [0, 1, *([2] if bad else [])]
    words = ["river", "stone", "vile"]
    model = toxicity.learn([say(True) for _ in range(100)], [say(k % 10 == 0) for k in range(600)], words, 0.1)
    assert toxicity.raw(model, "river vile") > np.log(0.7 / 0.3) > toxicity.raw(model, "river stone")


def test_sums_over_a_table_are_those_of_its_rows(spark):
    words = ["river", "stone", "vile"]
    docs = rows_of(spark, None, "", "river", "vile river", "River vile", "stone " * 30_000, *["vile stone"] * 500)
    whole, w, b = toxicity.Everywhere(docs, words, docs.count()), np.array([0.5, -1.0, 3.0]), -0.25
    assert whole.lists.count() == 5
    rows = toxicity.Sample([[], [], [0], [0, 2], [0, 2], [1], *[[1, 2]] * 500])
    (loss, gradient), (found, by_word) = rows.negative(w, b), whole.negative(w, b)
    assert abs(loss - found) < 1e-4 and np.abs(gradient - by_word).max() < 1e-4
    scores, counts = whole.spread(w, b)
    assert counts.sum() == 506 and np.abs(np.repeat(scores, counts.astype(int)) - np.sort(rows.scores(w, b))).max() <= 0.5 / toxicity.BINS


def test_prior_is_bounded_by_the_words_of_positives():
    in_p, in_u = {"vile": 90, "the": 100, "rare": 4, **{f"chance{k}": 11 for k in range(9)}}, {"vile": 1000, "the": 9900, "rare": 4, **{f"chance{k}": 110 for k in range(9)}}
    assert 0.1 <= toxicity.class_prior({k: n for k, n in in_p.items() if "chance" not in k}, 100, in_u, 10_000) <= 0.13
    assert toxicity.class_prior(in_p, 1000, in_u, 10_000) == toxicity.class_prior({"the": 100}, 1000, in_u, 10_000)


def test_a_cut_that_finds_next_to_nothing_is_worth_nothing():
    """Few positives score higher than any unlabelled row; the cut still goes where most positives are."""
    model = toxicity.calibrated(toxicity.ToxicityModel({}, 0.0), np.r_[np.full(4, 9.0), np.full(96, 3.0)], np.array([3.0, 0.0]), np.array([100, 900]), 0.1)
    assert 0 < np.log(0.7 / 0.3) - model.bias < 3


# --- 9: personal data ---

KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text):
    out = []
    for kind, pattern in KINDS.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0
            if {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 13 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]:
                out.append((kind, m.start(), m.end()))
    return out


def test_pii(spark):
    texts = [None, "", "é😀 a@b.c_d@e.f.g", "1.2.3.4.5.6.7.8 256.1.1.1 000255.1.1.1 1.2.3", "4111 1111-1111 1111 and 4111111111111112 0000000000000", "+1 (555) 123-4567. +12 +1234567890123456", "1" * 30000, "a" * 30000 + "@b.c", "+" + "1 " * 20000, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" x', "x@y.z " * 300]
    texts += [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    docs = rows_of(spark, *texts)
    model = pii_spans.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    found = pii_spans.find(docs, model)
    got = {r.doc_id: r for r in found.collect()}
    for i, t in enumerate(texts):
        spans = [(s.kind, s.start, s.end) for s in got[i].spans]
        assert [s for s in spans if s[0] in KINDS] == brute_spans(t), t[:80]
        assert all(t[s.start : s.end] == s.match for s in got[i].spans)
    assert "secret" in [s.kind for s in got[9].spans]
    clean = {r.doc_id: r.text for r in pii_spans.redact(found).collect()}
    assert clean[2] == "é😀 [EMAIL][EMAIL]" and clean[0] is None and clean[1] == "" and "[SECRET]" in clean[9] and clean[6] == texts[6]
    assert pii_spans.find(docs.where("false"), pii_spans.fit(docs.where("false"))).count() == 0


def test_long_tokens_are_candidates(spark):
    """Tokens of any length with a digit anywhere, also in a text that is one long token."""
    tokens = ["04dbebab91ab85687d33eeaaf9ac699e1188f962" * 5, "a" * 60 + "0" + "b" * 20, "x" * 200000 + "7", "f" * 15 + "1"]
    docs = rows_of(spark, *[f'token = "{t}" x' for t in tokens], "q" * 200000, "word_" * 9)
    got = {r.doc_id: [c.match for c in r._c] for r in pii_spans._votes(pii_spans.base_spans(docs.select("doc_id", "text"))).select("doc_id", "_c").collect()}
    assert got == {**{i: [t] for i, t in enumerate(tokens)}, 4: [], 5: []}


def test_identifiers_of_the_gazetteer_are_found(spark):
    said = {"ssn": "123-45-6789", "passport": "C01234567", "iban": "DE89 3704 0044 0532 0130 00"}
    model = pii_spans.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    found = pii_spans.find(rows_of(spark, *[f'{k}: "{v}" x' for k, v in said.items()]), model)
    assert [[s.match for s in r.spans] for r in found.orderBy("doc_id").collect()] == [[v] for v in said.values()]


def test_votes_are_weighed_by_reliability():
    rng = np.random.default_rng(9)
    truth = rng.random(4000) < 0.3
    hit, false = np.array([0.9, 0.85, 0.8, 0.7, 0.55]), np.array([0.05, 0.1, 0.1, 0.2, 0.5])
    votes = (rng.random((4000, 5)) < np.where(truth[:, None], hit, false)).astype(float)
    patterns, n = np.unique(votes, axis=0, return_counts=True)
    q, reliability = pii_spans.aggregate_votes(patterns, n.astype(float))
    said = {tuple(p): v for p, v in zip(patterns, q, strict=True)}
    assert np.mean([(said[tuple(v)] > 0.5) == t for v, t in zip(votes, truth, strict=True)]) > 0.93
    assert reliability["shape"][0] > reliability["varied"][0]


# --- the pipeline ---


def test_pipeline(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in cp.STAGES] == ["toxicity", "near_dedup", "decontamination", "pii", "packing"] and cp.ORACLE_SQL is None
    toxic = {r.doc_id for r in toxicity.score(docs, toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))).where("predicted = 1").collect()}
    left = sorted((r.doc_id, r.text) for r in docs.collect() if r.doc_id not in toxic)
    left = [left[i] for i, (_, low) in enumerate(brute_components([t for _, t in left])) if i == low]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    grams = set()
    for _, t in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
        grams |= {tuple(w[i : i + 10]) for i in range(len(w) - 9)}
    clean = []
    for d, t in left:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        if not any(tuple(w[i : i + 10]) in grams for i in range(len(w) - 9)):
            clean.append(d)
    rows = cp.run(spark, SF).collect()
    assert sorted({r.doc_id for r in rows}) == clean
    check_places(rows)
    stage = docs
    for _, f in cp.STAGES[:-1]:
        assert f(spark, stage.limit(20), SF).columns == docs.columns
