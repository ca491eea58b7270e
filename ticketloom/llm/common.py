"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import sys
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


_ON_ONE_MACHINE: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """A fresh path in the folder that driver and executors share.

    The folder is the session's ``spark.checkpoint.dir``. Only where that is unset and everything runs in one
    process (tests) a temporary folder takes its place; a cluster without the setting is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = _ON_ONE_MACHINE.setdefault(spark.sparkContext.applicationId, "") or "file://" + tempfile.mkdtemp(prefix="ticketloom-")
        _ON_ONE_MACHINE[spark.sparkContext.applicationId] = base
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame, instead: DataFrame | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage is cut and executors may be lost.

    ``instead``: a table written before that nothing reads any more once this one is there; it is deleted.
    """
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    if instead is not None:
        dropped(instead)
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` gave and that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(table._written_at)
        at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session with other ``values`` of settings for what is run inside; then those of before, or none, are back."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def together(df: DataFrame, *by: str) -> DataFrame:
    """``df`` with rows of equal ``by`` in one task, for Python that runs over whole partitions.

    Spark leaves out a repartition by the columns themselves where a join by them lies below, and may then read
    that join's shuffle by other parts, as nothing above it seems to need the keys together: a join turned into
    a broadcast, or a skewed one that is split. A hash of the columns is a shuffle of its own.
    """
    return df.repartition(F.xxhash64(*by))


def few(df: DataFrame, rows: int) -> DataFrame:
    """``df`` in fewer tasks where it comes from few rows: what tasks hand on takes some files each, however small.

    A task is left for each 20,000 of ``rows``, and eight at least; more tasks than there are aren't made.
    """
    return df.coalesce(max(8, rows // 20_000))


def forget() -> None:
    """Called by Python tasks of other operators than packing: a worker that is used again frees the words that packing remembered."""
    sys.modules.pop("ticketloom_worker", None)


def boxed(df: DataFrame, reads: list[str], makes: list[str] | tuple[str, ...] = ()) -> tuple[DataFrame, list[Column]]:
    """``df`` with the columns ``reads`` and all others under names of their own, and what gives the caller's columns back in order.

    The names are new each time, so an operator's own columns can't clash with the caller's, whatever those
    are called. Columns named as one of ``makes``, in any case, are left out: the operator replaces them.
    """
    row, gone = f"row_{uuid.uuid4().hex}", {m.lower() for m in makes}
    kept = [c for c in df.columns if c.lower() not in gone]
    rest = {c: f"{row}_{i}" for i, c in enumerate(kept) if c not in reads}
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    return df.select(*[quoted(c) for c in reads], *[quoted(c).alias(n) for c, n in rest.items()]), [F.col(rest[c]).alias(c) if c in rest else F.col(c) for c in kept]


def unboxed(df: DataFrame, own: list[Column], **made: Column) -> DataFrame:
    """The caller's columns and the ``made`` ones, which are worked out before any of the caller's names is back."""
    out = f"made_{uuid.uuid4().hex}"
    df = df.select("*", *[c.alias(f"{out}_{n}") for n, c in made.items()])
    return df.select(*own, *[F.col(f"{out}_{n}").alias(n) for n in made])


def held(df: DataFrame, **exprs: Column) -> DataFrame:
    """Adds columns that are evaluated once per row, also when lambdas refer to them many times.

    A one-element explode is a border that the optimizer doesn't inline expressions across.
    """
    for name, expr in exprs.items():
        df = df.select("*", F.explode(F.array(expr)).alias(name))
    return df


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z alone."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def placed(df: DataFrame, group: str, *order: str) -> DataFrame:
    """``df`` with ``pos``: each row's place, from 0, among those of its ``group`` in the order of the columns ``order``, nulls first.

    A range sort deals rows out by group and order together, so a group of any size is spread over tasks.
    Each part of it counts its own rows, and the counts of the parts before are carried over.
    """
    by = [group, *order]
    rows = written(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()))
    parts = rows.groupBy(F.col(group).alias("_group"), F.shiftright("_at", 33).alias("_part")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    # A written table has a known size, so that Spark can send it to the rows instead of dealing those out.
    parts = written(parts.select("_group", "_part", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift")))
    found = rows.join(parts, F.col(group).eqNullSafe(F.col("_group")) & (F.shiftright("_at", 33) == F.col("_part")))
    return found.select(*df.columns, (F.col("_at") + F.col("_shift")).alias("pos"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_sample(ids: DataFrame, rows: int, salt: str = "") -> DataFrame:
    """At most ``rows`` of the distinct ``doc_id`` in ``ids`` (with their other columns), the same ones in each run.

    Hashes below a share of their range are taken before any are sorted, so each task hands on few rows.
    """
    share = min(1.0, 1.1 * rows / max(1, ids.count()))
    hashed = F.xxhash64("doc_id", F.lit(salt))
    some = ids.where(F.pmod(hashed, F.lit(1 << 30)) < int(share * (1 << 30)))
    return some.dropDuplicates(["doc_id"]).orderBy(hashed, "doc_id").limit(rows)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, where: Column | None = None) -> DataFrame:
    """At most ``rows`` labelled documents (doc_id, text, label), the same ones in each run.

    Rows with a null id or label are left out; of several labels of one id the smallest counts, of several
    texts of one id the smallest. The broadcast side has at most ``rows`` rows of two numbers.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    if where is not None:
        known = known.where(where)
    picked = id_sample(known.groupBy("doc_id").agg(F.min(label).cast("int").alias("label")), rows)
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return found.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
