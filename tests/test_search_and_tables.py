"""Ranked search, keyed tables, cursor loads, histories, redirects and streamed counts against brute-force versions."""

import collections
import datetime
import math
import random
import re
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from ticketloom.operators import changes, relations, reports, search
from ticketloom.scratch import shared_path, written
from ticketloom.sources.keyed import KeyedTable, load_changes
from ticketloom.streaming import overview

T0 = datetime.datetime(2024, 1, 1)


def brute_search(docs, queries, k):
    words = {i: re.findall(r"[^\W_]+", (t or "").lower()) for i, t in docs}
    words = {i: w for i, w in words.items() if w}
    n, mean = len(words), sum(map(len, words.values())) / max(1, len(words))
    df = collections.Counter(t for w in words.values() for t in set(w))
    out = {}
    for q, terms in queries.items():
        need = {}
        for t, kind in terms:
            need[t.lower()] = min(need.get(t.lower(), "zz"), kind, key=["not", "must", "should", "zz"].index)
        found = []
        for i, w in words.items():
            if any(kind == "not" and t in w for t, kind in need.items()) or not all(t in w for t, kind in need.items() if kind == "must"):
                continue
            adds = [t for t, kind in need.items() if kind != "not" and t in w]
            if adds:
                found.append((-round(sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * w.count(t) * 2.2 / (w.count(t) + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t in adds), 9), i))
        out.update({(q, r + 1): (i, round(-s, 6)) for r, (s, i) in enumerate(sorted(found)[:k])})
    return out


@pytest.mark.parametrize("k", [1, 3, 50])
def test_search(spark, k):
    rnd = random.Random(k)
    letters = "aaaabbbccdefg"
    docs = [(i, " ".join(rnd.choices(letters, k=rnd.choice([1, 5, 30])))) for i in range(80)] + [(100, None), (101, ""), (102, "Ä b"), (103, "x" * 50000 + " a")]
    queries = {1: [("a", "should"), ("g", "should")], 2: [("a", "must"), ("B", "must"), ("f", "should")], 3: [("c", "should"), ("d", "not")], 4: [("zzz", "must"), ("a", "should")], 5: [("ä", "should"), ("Ä", "must")], 6: [("a", "not")], 7: [("a", "should"), ("b", "should"), ("c", "should"), ("e", "should"), ("a", "should")], 8: [("zzz", "should")], 9: [("g", "should"), ("f", "should"), ("a", "should"), ("e", "not")], 10: [("g", "should"), ("f", "should"), ("b", "should"), ("c", "not"), ("d", "not")]}
    index = search.build_index(spark.createDataFrame(docs, "id bigint, text string").repartition(3), "id", "text")
    asked = spark.createDataFrame([(q, t, kind) for q, said in queries.items() for t, kind in said], "query_id int, term string, need string")
    got = {(r.query_id, r["rank"]): (r.id, r.score) for r in search.search(index, asked, k).collect()}
    want = brute_search(docs, queries, k)
    assert {x: i for x, (i, _) in got.items()} == {x: i for x, (i, _) in want.items()} and all(abs(got[x][1] - want[x][1]) < 2e-6 for x in want)


def test_search_of_nothing(spark):
    none = spark.createDataFrame([], "id bigint, text string")
    asked = spark.createDataFrame([(1, "a", "should")], "query_id int, term string, need string")
    assert search.search(search.build_index(none, "id", "text"), asked).count() == 0


# --- keyed tables ---


def table_of(spark, rows, buckets=8):
    df = spark.createDataFrame(rows, "id bigint, subject string, modified timestamp_ntz")
    return df, KeyedTable(spark, shared_path(spark), df.schema, "id", buckets)


def test_changes_touch_their_buckets_only(spark):
    df, t = table_of(spark, [(i, f"s{i}", T0) for i in range(100)])
    assert t.rows().count() == 0 and t.folders() == {}
    t.change(df, lambda rows, new: new, "first")
    before = t.folders()
    patches = written(spark.createDataFrame([(7, "replace", "/subject", "new", 1)], "id bigint, op string, path string, value string, seq bigint"))
    read = []

    def apply(rows, p):
        read.extend(rows.inputFiles())
        return changes.apply_patches(rows, p)

    touched = t.change(patches, apply, "patch")
    assert len(touched) == 1 and len(before) == 8
    # The plan scans no file of an untouched bucket, and their folders stay as they were.
    assert read and all(before[touched[0]] in f for f in read)
    assert {b: f for b, f in t.folders().items() if b not in touched} == {b: f for b, f in before.items() if b not in touched}
    assert {r.id: r.subject for r in t.rows().collect()} == {i: "new" if i == 7 else f"s{i}" for i in range(100)}
    assert t.change(patches, changes.apply_patches, "patch") == []
    # A bucket may lose all its rows.
    gone = written(t.rows().where(t.bucket_of("id") == touched[0]).select("id"))
    t.change(gone, changes.delete, "delete")
    assert t.rows().where(t.bucket_of("id") == touched[0]).count() == 0 and t.rows().count() == 100 - gone.count()


def test_two_loads_equal_one(spark):
    """Rows that change, come late within the overlap, stay, and are new; a load that is repeated changes nothing."""
    hour = timedelta(hours=1)
    first = [(i, "old", T0 + i * hour) for i in range(20)]
    second = [(i, "new" if i % 3 == 0 else "old", T0 + (i + 100 * (i % 3 == 0)) * hour) for i in range(20)] + [(50, "late", T0 + 19 * hour - timedelta(minutes=3)), (51, "fresh", T0 + 200 * hour), (52, "too late", T0)]
    df, t = table_of(spark, first)
    load_changes(df, t, "modified", "a", store=written)
    assert t.mark() == T0 + 19 * hour
    full = spark.createDataFrame(second, df.schema)
    assert load_changes(full, t, "modified", "b", store=written) > 0 and load_changes(full, t, "modified", "b", store=written) == 0
    load_changes(full, t, "modified", "c", store=written)
    # What shows up later than the overlap allows is not seen.
    assert sorted(map(tuple, t.rows().collect())) == sorted(r for r in second if r[0] != 52)
    assert load_changes(full.where("false"), t, "modified", "d") == 0
    _, one = table_of(spark, [])
    load_changes(full, one, "modified", "a", store=written)
    assert sorted(map(tuple, one.rows().collect())) == sorted(second)


# --- histories and redirects ---


def test_status_history(spark):
    day = timedelta(days=1)
    log = [(1, "active", T0, 1), (1, "active", T0 + day, 2), (1, "closed", T0 + 2 * day, 3), (1, "active", T0 + 2 * day, 4), (2, "closed", T0 + day, 1), (3, None, T0, 1), (3, "pending", T0 + 4 * day, 2)]
    history = changes.status_history(spark.createDataFrame(log, "id int, status string, at timestamp_ntz, seq int"))
    assert sorted((r.id, r.status or "", r.start, r.end or T0) for r in history.collect()) == [(1, "active", T0, T0 + 2 * day), (1, "active", T0 + 2 * day, T0), (2, "closed", T0 + day, T0), (3, "", T0, T0 + 4 * day), (3, "pending", T0 + 4 * day, T0)]
    got = [(r.opened, r.closed, r.open) for r in changes.open_by_day(history).orderBy("day").collect()]
    assert got == [(1, 0, 1), (0, 0, 1), (1, 1, 1), (0, 0, 1), (1, 0, 2)]
    assert changes.open_by_day(history.where("false")).count() == 0


def test_status_history_of_ties(spark):
    """Changes of one time and place in the log count in the order of their statuses, in whatever order they are read."""
    day = timedelta(days=1)
    log = [(1, "closed", T0, 1), (1, "active", T0, 1), (1, "pending", T0 + day, 2), (2, "pending", T0, 1), (2, None, T0, 1), (2, "closed", T0, 1)]
    for rows in (log, log[::-1]):
        df = spark.createDataFrame(rows, "id int, status string, at timestamp_ntz, seq int").coalesce(1)
        got = sorted((r.id, r.status, r.start, r.end or T0) for r in changes.status_history(df).collect())
        assert got == [(1, "closed", T0, T0 + day), (1, "pending", T0 + day, T0), (2, "pending", T0, T0)]


def test_open_by_day_equals_its_sql_on_ties(spark, tmp_path):
    """The query and its SQL agree on a log full of ties, in whatever order its rows are stored."""
    duckdb = pytest.importorskip("duckdb")
    day = timedelta(days=1)
    log = [(i, f, T0 + d * day, 1) for i in range(50) for d in range(3) for f in ("A", "R", "N")]
    for k, rows in enumerate((log, log[::-1])):
        df = spark.createDataFrame(rows, "l_orderkey long, l_returnflag string, l_shipdate timestamp_ntz, l_linenumber int").coalesce(1)
        df.write.parquet(f"{tmp_path}/{k}/lineitem.parquet")
        got = [tuple(r) for r in entry.queries()["open_by_day"](spark, f"{tmp_path}/{k}").orderBy("day").collect()]
        with duckdb.connect() as con:
            con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/{k}/lineitem.parquet/*.parquet')")
            assert got == con.execute(f"SELECT * FROM ({entry.oracle_sql()['open_by_day']}) ORDER BY day").fetchall()
        # The order of statuses within a tie is active, closed, pending, so that each day ends pending.
        assert [r[1:] for r in got] == [(50, 0, 50), (50, 50, 50), (50, 50, 50)]


def test_open_by_day_of_ties(spark):
    """Days don't depend on the order in which changes of one time and place in the log are read."""
    day = timedelta(days=1)
    log = [(i, s, T0 + d * day, 1) for i in range(20) for d in range(3) for s in ("active", "pending", "closed")]
    for rows in (log, log[::-1]):
        history = changes.status_history(spark.createDataFrame(rows, "id int, status string, at timestamp_ntz, seq int").coalesce(1))
        got = [(r.day, r.opened, r.closed, r.open) for r in changes.open_by_day(history).orderBy("day").collect()]
        assert got == [((T0 + d * day).date(), 20, 0 if d == 0 else 20, 20) for d in range(3)]


def test_redirect_chains(spark):
    """A chain of a thousand hops, loops, what leads into them, other sites, repeats and nulls."""
    chain = [("a", f"u{i}", f"u{i + 1}") for i in range(1000)]
    rows = chain + [("b", "u0", "u1"), ("a", "x", "y"), ("a", "y", "x"), ("a", "z", "x"), ("a", "self", "self"), (None, "u1", "n"), ("a", "d", "u999"), ("a", "d", "u998"), ("a", "null", None), ("a", None, "u1")]
    got = {(r.site_id, r.url_mapping): (r.target, r.hops, r.looped) for r in relations.resolve_redirects(spark.createDataFrame(rows, "site_id string, url_mapping string, redirect string")).collect()}
    assert all(got["a", f"u{i}"] == ("u1000", 1000 - i, False) for i in range(1000))
    assert got["b", "u0"] == ("u1", 1, False) and got[None, "u1"] == ("n", 1, False) and got["a", "d"] == ("u1000", 3, False) and got["a", "null"] == (None, 1, False)
    assert all(got["a", u] == (None, None, True) for u in ("x", "y", "z", "self")) and len(got) == 1008
    assert relations.resolve_redirects(spark.createDataFrame([], "site_id string, url_mapping string, redirect string")).count() == 0


def test_states_roll_up(spark):
    rows = [(T0 + timedelta(days=i % 90), float(i % 1000), i % 777) for i in range(9000)] + [(T0, None, None)]
    df = spark.createDataFrame(rows, "at timestamp_ntz, v double, who bigint")
    states = written(reports.partial_states(df, "v", "who"))
    assert states.count() == 90
    year = reports.rolled_up(states, "year").first()
    assert year.n == 9000 and abs(year.mean - 499.5) < 1e-9 and abs(year["median"] - 500) <= 20 and abs(year.p90 - 900) <= 20 and abs(year["distinct"] - 777) <= 50
    direct = reports.rolled_up(reports.partial_states(df.withColumn("at", F.lit(T0)), "v", "who"), "year").first()
    assert abs(direct["distinct"] - year["distinct"]) <= 20 and reports.rolled_up(states, "month").count() == 3


# --- the overview as a stream ---


def test_streamed_overview(spark):
    """After each file the sums of moves are the counts of a batch over all changes so far; late and repeated changes move nothing."""
    at, rnd = shared_path(spark), random.Random(5)
    schema = "id bigint, agent_id bigint, status string, seq bigint, at timestamp"
    said = [(i, rnd.choice([1, 2, None]), rnd.choice(["active", "pending", "closed", "spam"]), s, T0) for i in range(30) for s in range(4)]
    rnd.shuffle(said)
    for k in range(3):
        spark.createDataFrame(said[40 * k : 40 * k + 40] + said[:5] * (k > 0), schema).coalesce(1).write.mode("append").parquet(f"{at}/in")
        stream = spark.readStream.schema(schema).parquet(f"{at}/in")
        overview.overview_moves(stream).writeStream.format("parquet").option("checkpointLocation", f"{at}/checkpoint").outputMode("append").trigger(availableNow=True).start(f"{at}/out").awaitTermination()
        last = {}
        for r in said[: 40 * k + 40]:
            last[r[0]] = max(last.get(r[0], r), r, key=lambda x: x[3])
        want = collections.Counter((a, s if s in ("pending", "closed") else "active") for _, a, s, _, _ in last.values())
        got = {(r.agent_id, s): r[s] for r in overview.overview(spark.read.schema(overview.MOVES).parquet(f"{at}/out")).collect() for s in ("active", "pending", "closed") if r[s]}
        assert got == dict(want)


def test_closed_conversations_leave_the_overview(spark):
    """Seven days after a conversation was closed, by the watermark, its count is taken back and its state goes."""
    at, day = shared_path(spark), timedelta(days=1)
    schema = "id bigint, agent_id bigint, status string, seq bigint, at timestamp"
    for rows in ([(1, 1, "closed", 1, T0), (2, 1, "active", 1, T0)], [(3, 1, "active", 1, T0 + 20 * day)], [(4, 1, "active", 1, T0 + 21 * day)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{at}/in")
        stream = spark.readStream.schema(schema).parquet(f"{at}/in")
        overview.overview_moves(stream, timedelta(days=7)).writeStream.format("parquet").option("checkpointLocation", f"{at}/checkpoint").outputMode("append").trigger(availableNow=True).start(f"{at}/out").awaitTermination()
    got = overview.overview(spark.read.schema(overview.MOVES).parquet(f"{at}/out")).first()
    assert (got.active, got.closed) == (3, 0)


def test_overview_of_large_agents_and_few_states(spark):
    """Ids of agents above 2^53 next to nulls come back as they were, and conversations share the states of few buckets."""
    at, big = shared_path(spark), 2**53 + 1
    schema = "id bigint, agent_id bigint, status string, seq bigint, at timestamp"
    spark.createDataFrame([(i, None if i % 2 else big, "active", 1, T0) for i in range(200)], schema).coalesce(1).write.parquet(f"{at}/in")
    stream = spark.readStream.schema(schema).parquet(f"{at}/in")
    query = overview.overview_moves(stream, buckets=8).writeStream.format("parquet").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start(f"{at}/out")
    query.awaitTermination()
    got = {(r.agent_id, r.active) for r in overview.overview(spark.read.schema(overview.MOVES).parquet(f"{at}/out")).collect()}
    assert got == {(None, 100), (big, 100)} and query.lastProgress.stateOperators[0].numRowsTotal == 8
