"""What the catalogs' plans share."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.graph import materialize


def typed(bronze: DataFrame, schema: str) -> DataFrame:
    """Bronze objects parsed by an explicit schema; raw, file and pos stay."""
    keep = [c for c in bronze.columns if c != "raw"]
    return bronze.select(*keep, "raw", F.from_json("raw", schema).alias("o")).select(*keep, "raw", "o.*")


def parsed(bronze: DataFrame, schema: str) -> DataFrame:
    """typed, written once: each of a catalog's tables reads its columns from there instead of parsing all JSON again."""
    return materialize(typed(bronze, schema), "parsed")


def rejects(objects: DataFrame, known: Iterable[str], dropped: Iterable[str]) -> DataFrame:
    """(type, reason, n) of objects that take no part: boilerplate, or of an unexpected type."""
    kind = F.coalesce(F.col("type"), F.lit(""))
    return objects.where(~kind.isin(*known)).groupBy(kind.alias("type")).agg(F.count("*").alias("n")).withColumn("reason", F.when(F.col("type").isin(*dropped), "boilerplate").otherwise("unexpected type"))


def union(tables: Iterable[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def present(value: Column) -> Column:
    """Empty text as absent."""
    return F.when(value != "", value)
