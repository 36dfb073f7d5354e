"""Deterministic identifiers as native expressions, and canonical JSON."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_URL_SPACE = uuid.NAMESPACE_URL.hex


def uuid5(seed: Column) -> Column:
    """Version-5 UUID of a string in the URL namespace: SHA-1 with the version and variant bits set. Null stays null."""
    h = F.sha1(F.concat(F.unhex(F.lit(_URL_SPACE)), F.encode(seed, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def python_list(items: Column) -> Column:
    """An array of strings as Python prints a list of them; identifiers of edges with list attributes hash this text."""

    def quoted(x: Column) -> Column:
        plain = F.replace(F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("\t"), F.lit("\\t"))
        double = F.contains(x, F.lit("'")) & ~F.contains(x, F.lit('"'))
        return F.when(double, F.concat(F.lit('"'), plain, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(plain, F.lit("'"), F.lit("\\'")), F.lit("'")))

    return F.concat(F.lit("["), F.array_join(F.transform(items, quoted), ", "), F.lit("]"))


def seed_text(column: Column, is_list: bool = False) -> Column:
    return python_list(column) if is_list else column.cast("string")


def edge_id(namespace: str, source: Column, kind: Column, target: Column, attributes: Mapping[str, Column] | None = None) -> Column:
    """relationship--uuid5 of namespace, endpoints and kind; given attributes join the seed as |name=value in order of name, absent (null) ones do not."""
    extra = [F.concat(F.lit(f"{name}="), value) for name, value in sorted((attributes or {}).items())]
    return F.concat(F.lit("relationship--"), uuid5(F.concat(F.lit(f"{namespace}:"), F.concat_ws("|", source, kind, target, *extra))))


def node_id(namespace: str, kind: str, seed: Column) -> Column:
    """<kind>--uuid5 of namespace, kind and the node's natural or private key."""
    return F.concat(F.lit(f"{kind}--"), uuid5(F.concat(F.lit(f"{namespace}:{kind}:"), seed)))


@F.pandas_udf(T.StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    """JSON text with sorted keys as Python's json.dumps writes it; number spelling (10 or 10.0) is kept. Not expressible natively: to_json differs in separators, escapes and numbers."""
    return text.map(lambda t: json.dumps(json.loads(t), sort_keys=True), na_action="ignore")


@F.pandas_udf(T.StringType())
def record_json(text: pd.Series) -> pd.Series:
    """canonical_json of an object without its bookkeeping fields, those whose names begin with an underscore."""
    return text.map(lambda t: json.dumps({k: v for k, v in json.loads(t).items() if not k.startswith("_")}, sort_keys=True), na_action="ignore")


def record_hash(text: Column) -> Column:
    """SHA-256 of a record's canonical JSON without bookkeeping fields."""
    return F.sha2(record_json(text).cast("binary"), 256)


def content_hash(text: Column) -> Column:
    """SHA-256 of the canonical JSON."""
    return F.sha2(canonical_json(text).cast("binary"), 256)


def table_fingerprint(df: DataFrame) -> DataFrame:
    """One row (rows, hash): equal for equal bags of rows, whatever their order."""
    row = F.xxhash64(*[F.to_json(F.col(f"`{c}`")) if isinstance(df.schema[c].dataType, (T.MapType, T.StructType, T.ArrayType)) else F.col(f"`{c}`") for c in sorted(df.columns)])
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.bit_xor(row), F.lit(0)).alias("hash"), F.coalesce(F.sum(row.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("total"))


def register(spark: SparkSession) -> None:
    """SQL functions graph_uuid5(text), graph_slug(text) and graph_snake_case(text)."""
    from graphloom.functions.scalar import slug_sql, snake_case_sql

    h = f"sha1(concat(unhex('{_URL_SPACE}'), encode(seed, 'UTF-8')))"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION graph_uuid5(seed STRING) RETURNS STRING RETURN concat(substr({h},1,8),'-',substr({h},9,4),'-5',substr({h},14,3),'-',lower(hex((cast(conv(substr({h},17,1),16,10) AS INT) & 3) | 8)),substr({h},18,3),'-',substr({h},21,12))")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION graph_slug(label STRING) RETURNS STRING RETURN {slug_sql('label')}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION graph_snake_case(name STRING) RETURNS STRING RETURN {snake_case_sql('name')}")
