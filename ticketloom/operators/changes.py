"""Applying a batch of changes to a snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Paths that a patch may name, and the columns that they mean.
PATHS = {"/subject": "subject", "/status": "status", "/body": "body", "/firstName": "firstName", "/lastName": "lastName"}
WORKFLOW_STATUSES = ("active", "inactive")


def apply_patches(snapshot: DataFrame, patches: DataFrame) -> DataFrame:
    """Replaces columns by the latest patch (id, op, path, value, seq) of each path, and adds ``/phones`` values in order.

    Patches of other paths, or of columns that the snapshot lacks, are ignored. One shuffle of patches by id.
    """
    last = [F.max_by("value", F.when((F.col("op") == "replace") & (F.col("path") == p), F.col("seq"))).alias(f"_{c}") for p, c in PATHS.items() if c in snapshot.columns]
    seen = [F.max((F.col("op") == "replace") & (F.col("path") == p)).alias(f"_has_{c}") for p, c in PATHS.items() if c in snapshot.columns]
    phones = "phones" in snapshot.columns
    added = [F.transform(F.sort_array(F.collect_list(F.when((F.col("op") == "add") & (F.col("path") == "/phones"), F.struct("seq", "value")))), lambda x: x["value"]).alias("_phones")] if phones else []
    per = patches.groupBy(F.col("id").alias("_id")).agg(*last, *seen, *added)
    out = snapshot.join(per, snapshot["id"] == per["_id"], "left")
    new = {c: F.when(F.col(f"_has_{c}"), F.col(f"_{c}")).otherwise(snapshot[c]).alias(c) for c in PATHS.values() if c in snapshot.columns}
    if phones:
        new["phones"] = F.concat(F.coalesce(snapshot["phones"], F.array().cast("array<string>")), F.coalesce("_phones", F.array().cast("array<string>"))).alias("phones")
    return out.select(*[new.get(c, snapshot[c]) for c in snapshot.columns])


def check_workflow_statuses(patches: DataFrame) -> DataFrame:
    """Fails on a workflow status that is neither active nor inactive."""
    bad = ~F.col("value").isin(*WORKFLOW_STATUSES)
    return patches.withColumn("value", F.when(bad, F.raise_error(F.concat(F.lit("unknown workflow status "), F.col("value")))).otherwise(F.col("value")))


def replace_attributes(snapshot: DataFrame, changes: DataFrame, column: str) -> DataFrame:
    """Sets ``column`` to the last value (id, value, seq) of each id; a last value of null clears it."""
    last = changes.groupBy(F.col("id").alias("_id")).agg(F.max_by(F.struct(F.lit(True).alias("set"), "value"), "seq").alias("_new"))
    out = snapshot.join(last, snapshot["id"] == last["_id"], "left")
    return out.select(*[F.when(F.col("_new.set"), F.col("_new.value")).otherwise(snapshot[column]).alias(column) if c == column else snapshot[c] for c in snapshot.columns])


def upsert(snapshot: DataFrame, rows: DataFrame, seq: str = "seq") -> DataFrame:
    """Whole rows by id: the row with the highest ``seq`` counts, and any of ``rows`` before the snapshot's."""
    columns = snapshot.columns
    both = snapshot.select(F.lit(None).cast("bigint").alias("_seq"), *columns).unionByName(rows.select(F.col(seq).cast("bigint").alias("_seq"), *columns))
    per = both.groupBy("id").agg(F.max_by(F.struct(*columns), F.coalesce(F.col("_seq"), F.lit(-(1 << 63)))).alias("_row"))
    return per.select("_row.*")


def delete(snapshot: DataFrame, ids: DataFrame) -> DataFrame:
    return snapshot.join(ids.select("id").distinct(), "id", "left_anti")


def status_history(log: DataFrame) -> DataFrame:
    """(id, status, start, end): the time that each id was in each status, from a log (id, status, at, seq).

    Changes count in the order of at, then seq, then status, nulls first, so that no order is left to chance;
    equal statuses in a row are one interval; the last has no end.
    Intervals may be empty, where a status is left at the time that it was entered; these are left out.
    """
    order = Window.partitionBy("id").orderBy("at", "seq", "status")
    fresh = log.withColumn("_before", F.lag(F.struct("status")).over(order)).where(F.col("_before").isNull() | ~F.col("_before.status").eqNullSafe(F.col("status")))
    held = fresh.select("id", "status", F.col("at").alias("start"), F.lead("at").over(order).alias("end"))
    return held.where(F.col("end").isNull() | (F.col("start") < F.col("end")))


def open_by_day(history: DataFrame, statuses: tuple[str, ...] = ("active", "pending")) -> DataFrame:
    """(day, opened, closed, open): for each day from the first change to the last, how many ids became open, ceased to be, and were open at its end.

    A sweep over sums by day: only the sums, one row a day, are put in one order. An id that goes from one open
    status to another within a day counts as opened and closed.
    """
    some = history.where(F.col("status").isin(*statuses))
    moves = some.select(F.to_date("start").alias("day"), F.lit(1).alias("up")).union(some.where("end IS NOT NULL").select(F.to_date("end"), F.lit(-1)))
    sums = moves.groupBy("day").agg(F.count_if(F.col("up") == 1).alias("opened"), F.count_if(F.col("up") == -1).alias("closed"))
    days = sums.agg(F.explode(F.sequence(F.min("day"), F.max("day"))).alias("day"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    every = days.join(sums, "day", "left").select("day", zero("opened"), zero("closed"))
    return every.withColumn("open", F.sum(F.col("opened") - F.col("closed")).over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)))
