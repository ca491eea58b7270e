"""Writers: CSV of a projection, and JSON of cleaned or raw documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def csv_rows(df: DataFrame) -> DataFrame:
    """All columns as text in projection order, nulls empty."""
    return df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns])


def write_csv(df: DataFrame, path: str) -> None:
    """A header line, quotes where they are needed and doubled inside, missing values empty."""
    csv_rows(df).write.option("header", True).option("escape", '"').option("emptyValue", "").option("nullValue", "").csv(path)


def json_lines(df: DataFrame) -> DataFrame:
    """Each row as a JSON document; fields that are null are absent."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "true"}).alias("value"))


def write_clean_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def write_raw_json(df: DataFrame, path: str, raw: str = "raw") -> None:
    """The documents as they were landed."""
    df.select(F.col(raw).alias("value")).write.text(path)
