"""Readers of landed page documents, one JSON document for each file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketloom import schemas


def read_documents(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The documents at ``path``; one that isn't JSON is an error."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def embedded_items(pages: DataFrame, *keys: str) -> DataFrame:
    """One row for each item of ``_embedded``, of the first of ``keys`` that the page has; a page with none of them is an error."""
    items = F.coalesce(*[F.col("_embedded")[k] for k in keys])
    checked = F.when(items.isNull(), F.raise_error(F.lit(f"page has none of the keys {', '.join(keys)}"))).otherwise(items)
    return pages.select(F.explode(checked).alias("_item")).select("_item.*")


def read_hal_pages(spark: SparkSession, path: str, item: T.StructType, *keys: str) -> DataFrame:
    return embedded_items(read_documents(spark, path, schemas.embedded_page(item, *keys)), *keys)


def docs_items(pages: DataFrame, key: str) -> DataFrame:
    """Items of ``<key>.items``; no items give no rows, and a document without the wrapper is an item itself."""
    item = pages.schema[key].dataType["items"].dataType.elementType
    root = F.struct(*[F.col(f.name) for f in item.fields])
    found = F.when(F.col(key).isNull(), F.array(root)).otherwise(F.coalesce(F.col(key)["items"], F.array().cast(T.ArrayType(item))))
    return pages.select(F.explode(found).alias("_item")).select("_item.*")


def read_docs_pages(spark: SparkSession, path: str, item: T.StructType, key: str) -> DataFrame:
    return docs_items(read_documents(spark, path, schemas.docs_page(item, key)), key)


def unwrap(df: DataFrame, wrapper: str) -> DataFrame:
    """The object under ``wrapper``, or the document itself where it has none."""
    fields = df.schema[wrapper].dataType.fieldNames()
    inside = lambda f: F.col(wrapper)[f]
    pick = lambda f: F.when(F.col(wrapper).isNull(), F.col(f)).otherwise(inside(f)) if f in df.columns else inside(f)
    return df.select(*[pick(f).alias(f) for f in fields])


def page_audit(pages: DataFrame, by: Column | str = "collection") -> DataFrame:
    """Whether the landed pages of each collection are complete: all page numbers, and as many items as announced.

    ``pages``: collection, number, total_pages, total_elements, items (how many the page holds).
    """
    found = pages.groupBy(by).agg(F.max("total_pages").alias("total_pages"), F.count_distinct("number").alias("pages_found"), F.max("total_elements").alias("total_elements"), F.sum("items").alias("items_found"))
    return found.withColumn("complete", (F.col("total_pages") == F.col("pages_found")) & (F.col("total_elements") == F.col("items_found")))
