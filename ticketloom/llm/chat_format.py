"""Chat formatting: training windows of whole turns under a token budget, with loss masks.

Prefix sums of turn tokens, taken in Spark windows, choose the spans: they cut a conversation into blocks
of ``SPAN`` budgets, so that one of any length is formatted by many tasks, and within a block a window takes
turns while the running sum stays within the budget. Each window starts with the conversation's system
turn, where the first turn is one, then repeats up to ``history`` earlier turns, also of the block before.
Repeated turns are outside the loss mask, so each assistant text is a target once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketloom.llm.common import written

#: Marks of the template. Texts hold none of them once escaped.
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
BUDGET, HISTORY, PER_TURN = 1024, 2, 4
#: Budgets in a block of turns that one task formats.
SPAN = 64
WINDOWS = "conv_id string, window bigint, text string, loss array<struct<start:int,length:int>>, n_turns int, n_repeated int, n_tokens bigint, over_budget boolean"


def escape(c: Column) -> Column:
    """Breaks up control strings of common templates (``<|...``, ``</s>``, ``[INST]``); ``unescape`` is exact."""
    c = F.replace(c, F.lit("\\"), F.lit("\\0"))
    return F.replace(F.replace(c, F.lit("<"), F.lit("\\1")), F.lit("["), F.lit("\\2"))


def unescape(s: str) -> str:
    return s.replace("\\1", "<").replace("\\2", "[").replace("\\0", "\\")


def turn_tokens(c: Column) -> Column:
    """What a turn costs: words and punctuation marks, and the marks of the template."""
    return F.regexp_count(c, F.lit(r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]")).cast("bigint") + PER_TURN


def spans(turns: DataFrame, size: int, history: int) -> DataFrame:
    """(conv_id, block, kind, at): which turns ``at`` (a place in the order of all) each block holds: 0 the system turn of the conversation, 1 the last ones of the block before, 2 its own.

    ``turns``: conv_id, at, tokens, system (whether the role is system). A turn's block is the sum of the tokens
    before it in its conversation over ``size``. Sums are taken within parts of the order, and carried over by
    a second sum over the parts, so no conversation meets in one task.
    """
    part = turns.withColumn("part", F.shiftright("at", 33))
    totals = part.groupBy("conv_id", "part").agg(F.sum("tokens").alias("tokens"))
    earlier = lambda *by: F.coalesce(F.sum("tokens").over(Window.partitionBy("conv_id", *by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    carried = totals.select(F.col("conv_id").alias("_conv"), F.col("part").alias("_part"), earlier("part").alias("carried"))
    placed = part.withColumn("before", earlier("part", "at")).join(carried, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("part") == F.col("_part")))
    placed = placed.select("conv_id", "at", "system", (F.col("carried") + F.col("before")).alias("before")).withColumn("block", F.floor(F.col("before") / size))
    own = written(placed.withColumn("last", F.row_number().over(Window.partitionBy("conv_id", "block").orderBy(F.desc("at")))))
    # A turn that fills blocks is too long to be repeated, and so is all that comes before it.
    repeated = own.where(F.col("last") <= history).select("conv_id", (F.col("block") + 1).alias("block"), F.lit(1).alias("kind"), "at")
    first = own.where("before = 0 AND system").select(F.col("conv_id").alias("_conv"), "at")
    led = own.where("block > 0").select("conv_id", "block").distinct().join(first, F.col("conv_id").eqNullSafe(F.col("_conv"))).select("conv_id", "block", F.lit(0).alias("kind"), "at")
    return own.select("conv_id", "block", F.lit(2).alias("kind"), "at").union(repeated).union(led)


def format_chat(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, span: int = SPAN) -> DataFrame:
    """One row for each window of the conversations in ``turns`` (conv_id, turn, role, text).

    Order is by turn (nulls first); ties by role, then text; repeated rows are turns like any other. Null
    roles and texts are empty; turns without a conv_id form one conversation. A turn that alone exceeds the
    budget is kept whole, in a window marked ``over_budget``. ``window`` rises within a conversation. Loss
    offsets count code points of the window's text. An empty table gives no rows. Other columns are left
    out, so their names don't matter.
    """
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = ["conv_id", "turn", "role", "text"]
    rows = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("*", turn_tokens(F.col("text")).alias("tokens"), F.monotonically_increasing_id().alias("at")))
    dealt = spans(rows.select("conv_id", "at", "tokens", (F.col("role") == "system").alias("system")), span * budget, history)
    # Ids go to Python as text, so that they are exact also next to nulls.
    body = rows.select("at", "role", "tokens", F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT)).alias("head"), escape(F.col("text")).alias("t"))
    rows = dealt.withColumn("conv_id", F.col("conv_id").cast("string")).join(body, "at").repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "kind", "at")
    rows = rows.select("conv_id", "block", "kind", "role", "tokens", "head", "t")

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, system, recent, span, no, spent = None, [], [], [], 0, 0

        def leading() -> list:
            """The system turn, but in the window that it starts itself."""
            return system if no or here[1] else []

        def window() -> tuple:
            first = leading()
            lead = first + [x for x in recent[-history:] if x not in first] if history else first
            while lead[len(first) :] and sum(x[1] for x in lead) + spent > budget:
                lead = first + lead[len(first) + 1 :]
            text, loss = [], []
            at = 0
            for k, (role, _, head, body) in enumerate([*lead, *span]):
                if k >= len(lead) and role == "assistant":
                    loss.append((at + len(head), len(body)))
                text += [head, body, END]
                at += len(head) + len(body) + len(END)
            total = sum(x[1] for x in lead) + spent
            return here[0], (here[1] << 32) + no, "".join(text), [{"start": a, "length": n} for a, n in loss], len(span), len(lead), total, total > budget

        names = [f.split()[0] for f in WINDOWS.split(", ")]
        for b in batches:
            out = []
            for c, block, kind, role, tokens, head, body in zip(*[b[n] for n in ("conv_id", "block", "kind", "role", "tokens", "head", "t")], strict=True):
                c = c if isinstance(c, str) else None
                if here is None or (c, block) != here:
                    if span:
                        out.append(window())
                    here, system, recent, span, no, spent = (c, block), [], [], [], 0, 0
                turn = (role, int(tokens), head, body)
                if kind == 0:
                    system = [turn]
                    continue
                if kind == 1:
                    recent.append(turn)
                    continue
                # Prefix sums: the span ends where the system turn and the sum of its turns would pass the budget.
                if span and spent + turn[1] + sum(x[1] for x in leading()) > budget:
                    out.append(window())
                    recent, span, no, spent = [*recent, *span][-history:] if history else [], [], no + 1, 0
                if not span and not no and not block and role == "system":
                    system = [turn]
                span.append(turn)
                spent += turn[1]
            if out:
                yield pd.DataFrame(out, columns=names)
        if span:
            yield pd.DataFrame([window()], columns=names)

    return rows.mapInPandas(windows, WINDOWS).withColumn("conv_id", F.col("conv_id").cast(turns.schema["conv_id"].dataType))


def read_back(windows: DataFrame) -> DataFrame:
    """Digests of each conversation, read from its windows as a stream in order: a digest is bound to that order."""
    schema = "conv_id string, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_windows bigint"
    rows = windows.select(F.col("conv_id").cast("string").alias("conv_id"), "window", "text", "loss", "n_repeated").repartition("conv_id").sortWithinPartitions("conv_id", "window")

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, state = None, None

        def done() -> tuple:
            n, turns, lost, loss, chars, count = state
            return conv, n, turns.hexdigest(), lost, loss.hexdigest(), chars, count

        names = [f.split()[0] for f in schema.split(", ")]
        for b in batches:
            out = []
            for c, text, loss, repeated in zip(b["conv_id"], b["text"], b["loss"], b["n_repeated"], strict=True):
                c = c if isinstance(c, str) else None
                if state is None or c != conv:
                    if state:
                        out.append(done())
                    conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for turn in text.split(END)[:-1][repeated:]:
                    role, _, body = turn.removeprefix(TURN).partition(TEXT)
                    state[0] += 1
                    state[1].update(f"{unescape(role)}\n{unescape(body)}\n".encode())
                for x in loss:
                    got = unescape(text[x["start"] : x["start"] + x["length"]])
                    state[2] += len(got)
                    state[3].update(got.encode())
                state[4] += len(text)
                state[5] += 1
            if out:
                yield pd.DataFrame(out, columns=names)
        if state:
            yield pd.DataFrame([done()], columns=names)

    return rows.mapInPandas(digests, schema).withColumn("conv_id", F.col("conv_id").cast(windows.schema["conv_id"].dataType))
