"""Operators on hand-made records."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from ticketloom import schemas
from ticketloom.functions import patterns, predicates
from ticketloom.operators import briefing, changes, cleaning, names, redaction, relations, reports
from ticketloom.sources import pages, sinks
from ticketloom.streaming.redact import redact_stream

PERSON = "struct<id:bigint,type:string,first:string,last:string,email:string>"


def test_team_overview(spark):
    alex, jane = (42, "user", "Alex", "Morgan", "alex@test.com"), (55, "user", "Jane", "Doe", "jane@test.com")
    conv = spark.createDataFrame([(1, "active", alex), (4, "spam", None), (2, "pending", alex), (3, "closed", jane)], f"id bigint, status string, assignee {PERSON}")
    got = [tuple(r) for r in briefing.team_overview(conv).collect()]
    assert got == [(42, "Alex Morgan", "alex@test.com", 1, 1, 0), (55, "Jane Doe", "jane@test.com", 0, 0, 1), (None, "(unassigned)", "", 1, 0, 0)]
    assert tuple(briefing.team_totals(conv).first()) == (2, 1, 1)
    assert briefing.team_overview(conv.where("assignee is not null")).count() == 2 and briefing.team_overview(conv.where("false")).count() == 0
    assert tuple(briefing.agent_header(conv, 42).first()) == ("Alex Morgan", 1, 1, 0) and briefing.agent_header(conv, 9).first().agent is None


SUMMARIES = [
    ([], None, "", False, 0), (["customer@10:00", "customer@11:00"], None, "customer", True, 0), (["customer@10:00", "reply@11:30", "customer@12:00"], 90.0, "customer", True, 0),
    (["customer@10:00", "reply@11:00", "note@12:00"], 60.0, "reply", False, 0), (["customer@10:00", "note@11:00"], 60.0, "customer", True, 0),
    (["customer@10:00", "reply@11:00", "customer@12:00", "lineitem@13:00"], 60.0, "customer", True, 0), (["customer@10:00", "message@11:00"], 60.0, "message", False, 0),
    (["customer@10:00+2", "reply@11:00+1"], 60.0, "reply", False, 3), (["chat@11:00", "phone@12:00"], 60.0, "phone", False, 0),
]


def test_conversation_summary(spark):
    threads, conv = [], []
    for i, (said, *_) in enumerate(SUMMARIES):
        conv.append((i, "2025-01-01T10:00:00Z"))
        for pos, s in enumerate(said):
            kind, _, rest = s.partition("@")
            at, _, files = rest.partition("+")
            threads.append((i, pos, kind, f"2025-01-01T{at}:00Z", int(files or 0)))
    c = spark.createDataFrame(conv, "id bigint, t string").select("id", F.col("t").cast("timestamp").alias("created_at"))
    t = spark.createDataFrame(threads, "conv_id bigint, pos int, type string, created_at string, n_attachments int").withColumn("created_ts", F.col("created_at").cast("timestamp"))
    now = F.lit("2025-01-02T22:00:00Z").cast("timestamp")
    flat = {r.id: r for r in briefing.conversation_summary(c, t, now).collect()}
    nested = {r.id: r for r in briefing.nested_summary(relations.embed_threads(c, t), now).collect()}
    for i, (said, minutes, last, awaiting, files) in enumerate(SUMMARIES):
        for r in (flat[i], nested[i]):
            assert (r.thread_count, r.first_response_minutes, r.last_by, r.awaiting_reply, r.attachment_count, r.has_attachments, r.age_days) == (len(said), minutes, last, awaiting, files, files > 0, 1.5)
    assert flat[0].last_activity == ""


def test_overview_reads_no_threads(spark, tmp_path):
    spark.sql(f"select 1L as id, 'active' as status, cast(null as {PERSON}) as assignee, array('big') as threads").write.parquet(str(tmp_path / "c"))
    plan = briefing.team_overview(spark.read.parquet(str(tmp_path / "c")))._jdf.queryExecution().toString()
    assert "threads" not in plan[plan.index("ReadSchema") :]


def test_pages(spark, tmp_path):
    (tmp_path / "hal").mkdir()
    for n in (1, 2):
        (tmp_path / "hal" / f"{n}.json").write_text(json.dumps({"_embedded": {"teams": [{"id": n, "name": f"t{n}"}]}, "page": {"number": n, "totalPages": 2}}, indent=1))
    item = schemas._s("id BIGINT, name STRING")
    got = pages.read_hal_pages(spark, str(tmp_path / "hal"), item, "groups", "teams")
    assert sorted(tuple(r) for r in got.collect()) == [(1, "t1"), (2, "t2")]
    with pytest.raises(Exception, match="none of the keys"):
        pages.read_hal_pages(spark, str(tmp_path / "hal"), item, "users").collect()
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "1.json").write_text("{nonsense")
    with pytest.raises(Exception):
        pages.read_hal_pages(spark, str(tmp_path / "bad"), item, "teams").collect()
    (tmp_path / "docs").mkdir()
    article = schemas._s("id STRING, name STRING")
    for n, doc in enumerate(({"articles": {"page": 1, "pages": 1, "count": 1, "items": [{"id": "a", "name": "A"}]}}, {"articles": {"page": 1}}, {"id": "b", "name": "B"})):
        (tmp_path / "docs" / f"{n}.json").write_text(json.dumps(doc))
    assert sorted(r.id for r in pages.read_docs_pages(spark, str(tmp_path / "docs"), article, "articles").collect()) == ["a", "b"]
    wrapped = spark.createDataFrame([(("a", "A"), None, None), (None, "b", "B")], "article struct<id:string,name:string>, id string, name string")
    assert sorted(r.id for r in pages.unwrap(wrapped, "article").collect()) == ["a", "b"]


def test_csv_sink(spark, tmp_path):
    sinks.write_csv(spark.createDataFrame([(1, 'say "hi", you', None)], "id int, t string, x string").coalesce(1), str(tmp_path / "out"))
    text = next((tmp_path / "out").glob("part-*.csv")).read_text()
    assert text == 'id,t,x\n1,"say ""hi"", you",\n'


RAW = {
    "id": 1, "number": 9, "subject": "Help", "status": "active", "state": "published", "closedBy": 0, "closedByUser": {"id": 0, "email": "unknown"}, "primaryCustomer": {"id": 5, "first": "Alice", "last": "Smith", "email": "alice@test.com", "photoUrl": "u"},
    "assignee": {"id": 7, "first": "Bob", "last": "", "email": ""}, "createdBy": {"id": 5}, "customerWaitingSince": {"time": "2025-01-01T00:00:00Z", "friendly": "ages"}, "userUpdatedAt": "2025-01-02T00:00:00Z", "threads": 2, "tags": [], "preview": "", "cc": ["x@test.com"], "_links": {},
    "_embedded": {"threads": [
        {"id": 10, "type": "customer", "state": "published", "body": "<p>Hi <strong>you</strong></p>", "createdBy": {"first": "Alice", "last": "Smith", "email": "alice@test.com"}, "action": {"type": "default"}, "_embedded": {"attachments": [{"id": 3, "filename": "f.pdf", "mimeType": "a/b", "size": 5, "state": "x"}]}},
        {"id": 11, "type": "lineitem", "state": "draft", "action": {"type": "t", "text": "Bob assigned"}, "source": {"type": "web", "via": "user"}}]},
}


def test_clean_conversation(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps(RAW))
    df = pages.read_documents(spark, str(tmp_path / "c.json"), schemas.CONVERSATION)
    got = json.loads(sinks.json_lines(cleaning.clean_conversation(df)).first().value)
    assert got == {
        "id": 1, "number": 9, "subject": "Help", "status": "active", "updatedAt": "2025-01-02T00:00:00Z", "customer": "Alice Smith (alice@test.com)", "assignee": "Bob", "customerWaitingSince": "2025-01-01T00:00:00Z", "cc": ["x@test.com"],
        "threads": [{"id": 10, "type": "customer", "body": "Hi **you**", "from": "Alice Smith (alice@test.com)", "attachments": [{"id": 3, "filename": "f.pdf", "mimeType": "a/b", "size": 5}]}, {"id": 11, "type": "lineitem", "state": "draft", "action": "Bob assigned"}],
    }


def test_clean_other_records(spark, tmp_path):
    (tmp_path / "k.json").write_text(json.dumps({"id": 1, "firstName": "A", "lastName": "", "gender": "Unknown", "draft": False, "photoType": "default", "photoUrl": "u", "_embedded": {"emails": [{"id": 1, "value": "a@x.com"}], "phones": []}}))
    got = json.loads(sinks.json_lines(cleaning.clean_customer(pages.read_documents(spark, str(tmp_path / "k.json"), schemas.CUSTOMER))).first().value)
    assert got == {"id": 1, "firstName": "A", "emails": [{"id": 1, "value": "a@x.com"}]}
    org = cleaning.clean_organization(spark.createDataFrame([(1, "", [])], "id int, name string, domains array<string>")).first()
    assert org.name == "" and org.domains is None
    assert cleaning.clean_saved_reply(spark.createDataFrame([("<b>x</b>",)], "text string")).first().text == "**x**"


def test_redact_text(spark):
    ident = "struct<type:string,first:string,last:string,email:string,phone:string>"
    alice, brenda = ("customer", "Alice", "Smith", "alice@example.com", "+1 555 123 4567"), ("user", "Brenda", "Torres", "brenda@example.com", None)
    text = "Alice Smith asked Brenda Torres; ALICE wrote from alice@example.com. Carol Jones too, bob@example.org"
    df = spark.createDataFrame([(text, [alice, brenda], ["Carol Jones", "Brenda"]), ("", [], []), (None, None, None)], f"t string, i array<{ident}>, n array<string>")
    got = [r.t for r in redaction.redact_text(df, "t", "customers", "i", "n").collect()]
    assert "Alice" not in got[0] and "ALICE" not in got[0] and "alice@" not in got[0] and "Carol" not in got[0] and "bob@" not in got[0] and "Brenda Torres" in got[0] and got[1] == "" and got[2] is None
    assert got[0] == redaction.redact_text(df, "t", "customers", "i", "n").first().t
    assert redaction.redact_text(df, "t", "off", "i", "n").first().t == text and redaction.redact_text(df, "t", "all", "i").first().t == redaction.NOTICE
    assert redaction.redact_text(df, "t", "all", "i", "n", secret="s").first().t != redaction.redact_text(df, "t", "all", "i", "n").first().t


def test_modes():
    assert [redaction.normalize_mode(m) for m in (" ALL ", "customers", "x", None)] == ["all", "customers", "off", "off"]
    assert redaction.effective_mode("all", True, True) == "off" and redaction.effective_mode("all", False, False) == "all"
    with pytest.raises(PermissionError):
        redaction.effective_mode("all", False, True)


def test_redact_struct(spark):
    schema = f"id bigint, primaryCustomer {PERSON}, assignee {PERSON}, subject string, cc array<string>, emails array<struct<value:string>>, email string, firstName string, type string"
    rows = [(1, (5, "customer", "A", "B", "a@x.com"), (0, None, "S", "T", "unknown"), "hello", ["c@x.com"], [("v@x.com",)], "m@x.com", "F", "customer")]
    r = redaction.redact_struct(spark.createDataFrame(rows, schema), "customers").first()
    assert r.primaryCustomer.first != "A" and r.primaryCustomer.email.endswith("@anon.local") and r.assignee.first == "S" and r.subject == redaction.NOTICE
    assert r.cc[0].endswith("@anon.local") and r.emails[0].value.endswith("@anon.local") and r.email.endswith("@anon.local") and r.firstName != "F"
    assert redaction.redact_struct(spark.createDataFrame(rows, schema), "off").first().subject == "hello"


def test_chunks(spark):
    for text, most in (("", 5), ("a\nb c", 3), ("x" * 20, 7), ("aa bb cc dd\nee", 6), ("<a><b><c>", 4)):
        found = names.cuts(text, most)
        assert "".join(t for _, t in found) == text and all(len(t) <= most for _, t in found) and all(text[at:].startswith(t) for at, t in found)
    assert [t for _, t in names.cuts("one two\nthree four", 10)] == ["one two\n", "three four"]


BIG = (1 << 53) + 1


def test_names_keep_ids_and_count_failures(spark):
    """Ids above 2^53 next to a null one; a chunk that the detector fails on has no names, and is counted."""
    df = spark.createDataFrame([(BIG, "Ann went"), (None, "Ann too"), (BIG + 2, "boom Ann"), (7, None)], "doc_id bigint, text string").coalesce(1)

    def make():
        def detect(texts):
            if "boom" in texts[0]:
                raise RuntimeError("broken")
            return [[(t.find("Ann"), t.find("Ann") + 3, 0.9)] if "Ann" in t else [] for t in texts]

        return detect

    failed = spark.sparkContext.accumulator(0)
    got = names.detect_names(df, make, failed).collect()
    assert sorted((r.doc_id or 0, r.start, r.end, r.text) for r in got) == [(0, 0, 3, "Ann"), (BIG, 0, 3, "Ann")] and failed.value == 1
    assert sorted((r.doc_id or 0, r.chunk_id) for r in names.chunk_text(df).collect()) == [(0, 0), (7, 0), (BIG, 0), (BIG + 2, 0)]
    assert names.detect_names(df.where("false"), make).count() == 0


def test_spans(spark):
    rows = [(1, 0, 0, "B-PER", 0.9, 0, 0), (1, 0, 1, "B-PER", 0.9, 3, 7), (1, 0, 2, "I-PER", 0.8, 8, 12), (1, 0, 3, "O", 0.9, 13, 15), (1, 0, 4, "I-PER", 0.99, 16, 20), (1, 0, 5, "B-PER", 0.5, 21, 25), (1, 0, 6, "B-PER", 0.75, 26, 30)]
    tokens = spark.createDataFrame(rows, "doc_id int, chunk_id int, tok_idx int, label string, conf double, start int, end int")
    text = spark.createDataFrame([(1, 0, "x" * 3 + "Mary Jane" + " " * 40)], "doc_id int, chunk_id int, text string")
    assert sorted((r.start, r.end, round(r.score, 4)) for r in names.merge_person_spans(tokens).collect()) == [(3, 12, 0.85), (26, 30, 0.75)]
    assert [r.text for r in names.merge_person_spans(tokens, text).collect()] == ["Mary Jane"]
    got = spark.createDataFrame([([0.0, 2.0],), ([1.0] * 9,), ([],), (None,)], "s array<double>").select(names.decode_logits("s").alias("d")).collect()
    assert [r.d.label for r in got] == ["B-PER", "O", "O", "O"] and abs(got[0].d.confidence - 0.880797) < 1e-5
    with pytest.raises(ValueError):
        names.label_map({0: "O", 2: "B-PER"})


def test_policy(spark):
    asked = spark.createDataFrame([("b", "tags", "read"), ("a", "users", "delete")], "command string, resource string, operation string")
    assert [r.decision for r in relations.policy_audit(spark, asked, "tags:read, , ").collect()] == ["DENY", "ALLOW"]
    assert [r.decision for r in relations.policy_audit(spark, asked, "").collect()] == ["ALLOW", "ALLOW"] == [r.decision for r in relations.policy_audit(spark, asked, "*:*").collect()]
    for bad in ("tags", ":read", "tags:fly"):
        with pytest.raises(ValueError):
            relations.parse_policy(bad)


def test_changes(spark):
    snap = spark.createDataFrame([(1, "old", ["1"]), (2, "keep", None)], "id int, subject string, phones array<string>")
    patch = spark.createDataFrame([(1, "replace", "/subject", "b", 2), (1, "replace", "/subject", "a", 1), (1, "add", "/phones", "3", 4), (1, "add", "/phones", "2", 3), (1, "replace", "/x", "y", 9)], "id int, op string, path string, value string, seq int")
    assert sorted(map(tuple, changes.apply_patches(snap, patch).collect())) == [(1, "b", ["1", "2", "3"]), (2, "keep", [])]
    cleared = changes.replace_attributes(snap, spark.createDataFrame([(2, "x", 1), (2, None, 2)], "id int, value string, seq int"), "subject")
    assert {r.id: r.subject for r in cleared.collect()} == {1: "old", 2: None}


def test_filters_that_are_absent(spark):
    df = spark.createDataFrame([(1, 2, "manual", "n", None, "d", "s", "private", "c", "published")], "id int, mailbox_id int, type string, name string, text string, domain string, site_id string, visibility string, collectionId string, status string")
    for c in (predicates.workflows(), predicates.saved_replies(), predicates.organizations(), predicates.collections(), predicates.article_search("N"), predicates.workflows(2, "manual")):
        assert df.where(c).count() == 1
    for c in (predicates.workflows(3), predicates.saved_replies(0, "zzz"), predicates.organizations("zzz"), predicates.collections("t"), predicates.article_search("n", "x"), predicates.article_search("n", visibility="public")):
        assert df.where(c).count() == 0
    with pytest.raises(ValueError):
        predicates.by_visibility("hidden")


def test_reports_refuse(spark):
    df = spark.range(1)
    for call in (lambda: reports.sort_by(df, "score"), lambda: reports.report_rollup(df, "weather", F.lit(1), F.lit(2)), lambda: reports.sort_categories(df, "colour")):
        with pytest.raises(ValueError):
            call()


def test_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame([(k, f"F{k}", f"L{k}", f"u{k}@x.com") for k in range(20)], "id bigint, firstName string, lastName string, email string")
    df.write.parquet(str(tmp_path / "in"))
    redact = lambda d: redaction.redact_customer(d, "all")
    redact_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"), redact).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(tuple, redact(df).collect()))


PERSON_ABOVE = "struct<id:bigint,type:string,first:string,last:string,email:string"


def silent(texts):
    """A detector that finds no names."""
    return F.transform(texts, lambda t: F.array().cast("array<string>"))


def test_texts_know_the_persons_above_them(spark):
    """Two levels down names are lost, beside the person they stay, and arrays of arrays keep their order."""
    schema = f"id bigint, primaryCustomer {PERSON_ABOVE},threads:array<struct<body:string,notes:array<struct<text:string>>,createdBy:{PERSON_ABOVE},text:string>>>>, subject string, tags array<string>"
    inner = (7, "user", "Uma", "Vale", "uma@x.com", "Uma told Alice")
    threads = [("Alice one", [("Alice a",), (None,), ("",)], inner), ("two", [], None), ("three Smith", [("Alice z",)], inner), None]
    rows = [(1, (5, "customer", "Alice", "Smith", "alice@x.com", threads), "Alice asks", ["Alice"]), (2, None, None, None), (3, (0, "customer", "Alice", "Smith", "alice@x.com", threads), "Alice", [])]
    df = spark.createDataFrame(rows, schema)
    got = {r.id: r for r in redaction.redact_struct(df, "all", detect=silent, rules=[]).collect()}
    a, one = got[1], got[1].primaryCustomer
    fake = one.first
    assert fake != "Alice" and a.subject == "Alice asks" and a.tags == ["Alice"]
    assert [t and t.body for t in one.threads] == [f"{fake} one", "two", f"three {one.last}", None]
    assert [n.text for n in one.threads[0].notes] == [f"{fake} a", None, ""] and [n.text for n in one.threads[2].notes] == [f"{fake} z"]
    assert one.threads[0].createdBy.text == f"{one.threads[0].createdBy.first} told {fake}" and one.threads[1].createdBy is None
    assert got[2].primaryCustomer is None and got[2].subject is None
    # A placeholder is nobody, so its texts only lose the author's name.
    assert got[3].primaryCustomer.threads[0].body == "Alice one" and got[3].primaryCustomer.threads[0].createdBy.text == f"{one.threads[0].createdBy.first} told Alice"
    # In customer mode the author stays.
    mode = redaction.redact_struct(df.where("id = 1"), "customers", detect=silent, rules=[]).first().primaryCustomer
    assert mode.threads[0].createdBy.text == f"Uma told {mode.first}" and mode.threads[0].createdBy.first == "Uma"
    assert redaction.redact_struct(df.where("id = 1"), "all").first().primaryCustomer.threads[0].body == redaction.NOTICE
    assert redaction.redact_struct(df.where("false"), "all", detect=silent).count() == 0


def test_persons_by_shape(spark):
    """firstName records, phone-only ones, and e-mail before names, as the order of shapes says."""
    schema = "customer struct<firstName:string,lastName:string,phone:string,message:string>, line struct<phone:string,text:string>, contact struct<firstName:string,email:string,text:string>, odd struct<first:bigint,text:string>"
    row = (("Bob", "Stone", "555 1234", "Bob Stone 555 1234"), ("555 9876", "call 555 9876 or 555 1234"), ("Cleo", "cleo.m@x.com", "Cleo is cleo.m@x.com"), (3, "three"))
    r = redaction.redact_struct(spark.createDataFrame([row], schema), "all", detect=silent, rules=[]).first()
    assert r.customer.message.startswith(f"{r.customer.firstName} {r.customer.lastName} [[person_") and r.customer.message.endswith("]]")
    assert r.line.text.startswith("call [[person_") and r.line.text.endswith("or 555 1234")
    assert r.contact.text.startswith("Cleo is [[person_") and r.contact.firstName != "Cleo" and r.odd.text == "three" and r.odd.first == 3
    # Only records typed as customers are redacted in that mode; a firstName record counts as one by itself.
    r = redaction.redact_struct(spark.createDataFrame([row], schema), "customers", detect=silent, rules=[]).first()
    assert "Bob" not in r.customer.message and r.line.text == row[1][1]


def test_each_text_like_redact_text(spark):
    """Texts in an array lose what the same texts lose in a column."""
    ident = "struct<type:string,first:string,last:string,email:string,phone:string>"
    alice, brenda = ("customer", "Alice", "Smith", "alice@example.com", "+1 555 123 4567"), ("user", "Brenda", "Torres", "brenda@example.com", None)
    texts = ["Alice Smith asked Brenda Torres; ssn 123456789, alice@example.com", "my SSN is 123456789, call 212-555-0199", "", None, "Carol Jones lives at 12 Main Street. See www.example.com/x"]
    df = spark.createDataFrame([(i, t, [alice, brenda], ["Carol Jones", "Brenda"]) for i, t in enumerate(texts)], f"i int, text string, known array<{ident}>, n array<string>")
    want = [r.text for r in redaction.redact_text(df, "text", "customers", "known", "n", "key").orderBy("i").collect()]
    both = df.groupBy().agg(F.sort_array(F.collect_list(F.struct("i", "text", "known", "n"))).alias("x"))
    each = redaction.redact_each(F.transform("x", lambda x: F.struct(x["text"].alias("text"), x["known"].alias("known"))), F.transform("x", lambda x: x["n"]), "customers", "key")
    assert both.select(each.alias("t")).first().t == want


# --- names of a table ---


def brute_names(text, known):
    """From the left, the longest first: words with nothing but blanks between them."""
    word = r"[^\W_]+(?:['’-][^\W_]+)*"
    said, out, at = list(re.finditer(word, text or "")), [], 0
    lists = {tuple(re.findall(word, n)) for n in known if n}
    while at < len(said):
        fits = [n for n in range(1, len(said) - at + 1) if tuple(m[0] for m in said[at : at + n]) in lists and all(not text[said[k].end() : said[k + 1].start()].strip() for k in range(at, at + n - 1))]
        if fits:
            out.append((said[at].start(), said[at + max(fits) - 1].end(), " ".join(m[0] for m in said[at : at + max(fits)])))
        at += max(fits, default=1)
    return out


KNOWN = ["Ann Lee", "Ann", "Lee Ann Bo", "O'Neil-Smith Jr", "É Ça", "x1 y2 z3 w4", None, "", "...", "Ann Lee"]


def test_names_in_texts(spark):
    rnd = random.Random(3)
    texts = [None, "", "Ann\n Lee, Ann. Lee Ann Bo; ann lee", "O'Neil-Smith Jr's É Ça😀 É Ça_", "Lee Ann Lee Ann Bo", "Ann Ann Lee Ann", "x1 y2 z3 x1 y2 z3 w4", "word " * 1500 + "Ann Lee " * 3]
    texts += [" ".join(rnd.choice(["Ann", "Lee", "Bo", "É", "Ça", "Ann,", "x"]) for _ in range(30)) for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    table = spark.createDataFrame([(n,) for n in KNOWN], "name string")
    want = {i: brute_names(t, KNOWN) for i, t in enumerate(texts)}
    for got in (names.names_in_texts(df, table), names.detect_names(df, names.trie_detector(table)), names.detect_names(df, names.trie_detector(table), most=23, overlap=16)):
        found = {i: [] for i in want}
        for r in got.collect():
            found[r.doc_id].append((r.start, r.end, " ".join(r.text.split())))
        assert {i: sorted(x) for i, x in found.items()} == want
    assert names.names_in_texts(df, table.where("false")).count() == 0 and names.names_in_texts(df.where("false"), table).count() == 0
    with pytest.raises(ValueError):
        names.trie_detector(table, 3)


def test_names_over_pieces_of_a_text(spark, monkeypatch):
    """Texts are cut where words begin, at any character; names go over one or several edges, and no part of a word counts as one."""
    rnd = random.Random(5)
    bits = ["Ann", "Lee", "Bo", "É", "Ça😀", "Neil", "O'Neil-Smith", "x", " ", " ", " ", "  \n", "'", "-", "’", "--", ", "]
    texts = ["".join(rnd.choice(bits) for _ in range(60)) for _ in range(40)] + [" " * 40 + "Ann" + " " * 40 + "Lee", "Ann-" * 30 + "Ann Lee", "x--" * 30 + "Lee Ann Bo", "'" * 30 + "É Ça", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for known, piece in ((KNOWN, 1), (KNOWN, 16), (["Ann", "Lee", "O'Neil-Smith"], 5), (["Ann Lee"], 3)):
        monkeypatch.setattr(names, "PIECE", piece)
        found = {i: [] for i in range(len(texts))}
        for r in names.names_in_texts(df, spark.createDataFrame([(n,) for n in known], "name string")).collect():
            found[r.doc_id].append((r.start, r.end, r.text))
        assert {i: sorted(x) for i, x in found.items()} == {i: brute_names(t, known) for i, t in enumerate(texts)}


def test_names_of_texts_are_looked_for_in_compiled_code(spark):
    """From the words of a piece to what a bitmap lets through all is one compiled stage, so that no word costs an interpreted function."""
    df = spark.createDataFrame([(1, "a Ann Lee b")], "doc_id bigint, text string")
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else the plan isn't there before it runs
    try:
        plan = names.gazetteer_names(df, ["Ann Lee", "Bo"])._jdf.queryExecution().executedPlan().toString().split("\n")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    words = next(i for i, x in enumerate(plan) if "Generate posexplode" in x)
    stage = re.search(r"\*\(\d+\)", plan[words])[0]
    above = [x for x in plan[:words] if stage in x]
    assert len([x for x in above if "BroadcastHashJoin" in x and "Inner" in x]) == 2 and not any("lambdafunction" in x for x in above)


def test_a_word_of_any_length(spark):
    """A pattern that goes back over its repeats ran out of stack here, which ends the session."""
    df = spark.createDataFrame([(1, "a-" * 50_000 + "a Ann Lee"), (2, "Ann " + "b’c" * 50_000)], "doc_id bigint, text string")
    got = names.names_in_texts(df, spark.createDataFrame([("Ann Lee",), ("b’c" * 50_000,)], "name string")).collect()
    assert sorted((r.doc_id, r.start, r.end) for r in got) == [(1, 100_002, 100_009), (2, 4, 150_004)]


def test_words_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(names, "BLOCK", 4)
    texts = ["", "one", "a b, c d e", "é " * 9, "-- x'y z"]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", names.words_of(F.col("text")).alias("w")).collect()
    for r in got:
        assert [(x.word, x.start, x.end) for x in r.w] == [(m[0], m.start(), m.end()) for m in re.finditer(r"[^\W_]+(?:['’-][^\W_]+)*", texts[r.i])]


def test_a_name_over_an_edge_is_found_once(spark):
    """Chunks of 1,200 characters and of 512 tokens; the name starts in one and ends in the next."""
    for text in ("x" * 1190 + " Ann Lee Bo " + "y" * 1300, "x " * 511 + "Ann Lee Bo " + "y " * 40):
        df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
        chunks = [r.text for r in names.chunk_text(df, most_tokens=names.MOST_TOKENS).orderBy("chunk_id").collect()]
        assert "".join(chunks) == text and len(chunks) > 1 and all(len(re.findall(r"\w+|[^\w\s]", c)) <= 512 for c in chunks)
        assert not any("Ann Lee Bo" in c for c in chunks)
        table = spark.createDataFrame([("Ann Lee Bo",), ("Bo",), ("Lee Bo",)], "name string")
        assert [(r.start, r.end) for r in names.detect_names(df, names.trie_detector(table)).collect()] == [(text.index("Ann"), text.index("Ann") + 10)]


def test_threads_with_persons_and_names(spark):
    """Customer's and author's names go, the assignee's stay in customer mode, names of the table go; other conversations' persons stay."""
    person = "struct<type:string,first:string,last:string,email:string,phone:string>"
    bob = ("user", "Bob", "Stone", "bob@x.com", None)
    conv = spark.createDataFrame([(1, ("customer", "Alice", "Smith", "alice@x.com", None), bob), (2, None, None)], f"id bigint, customer {person}, assignee {person}")
    rows = [(1, 0, "Alice Smith and Bob Stone met Carol Jones, bob and carol jones", None, "keep"), (1, 1, "Dan here, not Carol", ("customer", "Dan", None, None, None), "keep"), (2, 0, "Alice and Carol Jones", None, "keep"), (3, 0, None, None, "keep"), (None, 0, "Alice", None, "keep")]
    threads = spark.createDataFrame(rows, f"conv_id bigint, pos int, body string, author {person}, note string")
    table = spark.createDataFrame([("Carol Jones",), ("Bob Stone",)], "name string")
    got = {(r.conv_id, r.pos): r for r in redaction.redact_threads(threads, conv, table, "customers").collect()}
    assert len(got) == 5 and all(r.note == "keep" for r in got.values())
    first = got[1, 0].body
    assert "Alice" not in first and "arol" not in first and "Bob Stone met" in first and first.endswith(first[first.index("met ") + 4 : first.index(",")])
    assert "Dan" not in got[1, 1].body and got[1, 1].body.endswith("not Carol")
    assert got[2, 0].body.startswith("Alice and ") and "Jones" not in got[2, 0].body and got[3, 0].body is None and got[None, 0].body == "Alice"
    assert redaction.redact_threads(threads, conv, table, "off") is threads


def test_json_of_unknown_schema(spark):
    """Equal to redact_struct where the schema is known; what documents don't agree on gives way to the notice."""
    schema = f"id bigint, primaryCustomer {PERSON_ABOVE},notes:array<struct<text:string>>>, subject string, cc array<string>, n double"
    rows = [(1, (5, "customer", "Alice", "Smith", "alice@x.com", [("Alice a",), (None,), ("x",)]), "Alice asks", ["c@x.com"], 1.5), (2, None, "é \" quoted", None, None), (3, (0, "customer", "Alice", "S", None, []), "Alice", [], 2.0)]
    df = spark.createDataFrame(rows, schema)
    want = [r.j for r in redaction.redact_struct(df, "all", detect=silent).select(F.to_json(F.struct(*df.columns)).alias("j")).collect()]
    raw = df.select(F.lit("own").alias("_out"), F.to_json(F.struct(*df.columns)).alias("raw"))
    got = redaction.redact_json(raw, "raw", "all", detect=silent)
    assert got.columns == raw.columns and [json.loads(r.raw) for r in got.collect()] == list(map(json.loads, want))
    odd = ['{"body":"Alice","v":1}', '{"body":{"x":"Alice"},"v":"one","customer":{"first":"Al","big":12345678901234567890.5}}', '[{"text":"Alice","email":"a@x.com"}]', '"Alice"', "7", "not json", None, "{}", '{"v":{"w":1},"odd key.`x":[]}']
    found = [r.raw and json.loads(r.raw) for r in redaction.redact_json(spark.createDataFrame([(t,) for t in odd], "raw string").coalesce(1), "raw", "all").collect()]
    notice = redaction.NOTICE
    assert found[0] == {"body": notice, "v": 1} and found[1]["body"] == notice and found[1]["v"] == "one" and found[1]["customer"]["first"] != "Al"
    assert found[2][0]["text"] == notice and found[2][0]["email"].endswith("@anon.local")
    assert found[3:7] == ["Alice", 7, None, None] and found[7] == {} and found[8] == {"v": notice, "odd key.`x": []}
    assert redaction.redact_json(spark.createDataFrame([("{}",), (None,)], "raw string"), "raw", "all").collect()[0].raw == "{}"
    assert redaction.redact_json(spark.createDataFrame([], "raw string"), "raw", "all").count() == 0


def test_records_of_one_part_are_dealt_out(spark):
    """A file that one task reads is redacted by many; before, its records stayed with that task."""
    rows = spark.range(0, 2000, 1, 1).select("id", F.concat(F.lit("call "), F.col("id")).alias("note"), F.lit("mail a@example.com").alias("text"))
    none = lambda texts: F.transform(texts, lambda t: F.array().cast("array<string>"))
    raw = rows.select("id", F.to_json(F.struct("note", "text")).alias("raw"))
    for out in (redaction.redact_struct(rows, "all", detect=none), redaction.redact_json(raw, "raw", "all", detect=none)):
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(sizes) < 1000 and sum(sizes) == 2000


def test_texts_of_one_part_are_dealt_out(spark):
    """Names, words and rule hits of a file that one task reads are found by many tasks."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = spark.range(0, 400, 1, 1).select(F.col("id").alias("doc_id"), F.concat(F.lit("call Ann Lee at 555-123-4567 "), F.col("id")).alias("text"))
    with_names = names.names_in_texts(docs, spark.createDataFrame([("Ann Lee",)], "name string"))
    plan = with_names._jdf.queryExecution().optimizedPlan().toString()
    assert with_names.count() == 400 and f"Repartition {parts}, true" in plan
    chunks = names.chunk_text(docs)
    assert chunks.select(F.spark_partition_id()).distinct().count() == parts and chunks.count() == 400
    hits = patterns.count_hits(spark.createDataFrame([(1, "mail a@x.com or b@x.com"), (2, "none")], "doc_id int, text string"), "text").orderBy("doc_id").collect()
    assert [(r.rule_0, r.rule_1) for r in hits] == [(2, 0), (0, 0)]
