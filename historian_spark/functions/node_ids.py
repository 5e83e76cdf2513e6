"""Canonical node ids, slugs and other naming rules, in Python and as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Identifier kinds of node ids.
KINDS = {"int": "i", "str": "s", "guid": "g", "bytes": "b"}
#: Built-in types and their Spark types; every other type is a string.
SPARK_TYPES = {
    "Boolean": "boolean", "SByte": "smallint", "Byte": "smallint", "Int16": "smallint", "UInt16": "int", "Int32": "int", "UInt32": "bigint", "Int64": "bigint",
    "UInt64": "decimal(20,0)", "Float": "float", "Double": "double", "String": "string", "DateTime": "timestamp", "Guid": "string",
}
SLUG_LENGTH = 48
COLUMN_NAME = re.compile(r"[a-zA-Z_][a-zA-Z0-9_]*")
TABLE_NAME = re.compile(r"[\w\-]+")


def format_node_id(namespace: int, identifier) -> str:
    kind = KINDS.get({int: "int", str: "str", bytes: "bytes"}.get(type(identifier), ""), "x")
    return f"ns={namespace};{kind}={identifier}"


def node_id(value) -> str:
    """A node id from text that is one already, or from a (namespace, identifier) pair."""
    if isinstance(value, str) and value.startswith("ns=") and ";" in value:
        return value
    if isinstance(value, tuple) and len(value) == 2:
        return format_node_id(*value)
    raise TypeError(f"not a node id: {value!r}")


def slug_column(namespace: Column, identifier: Column) -> Column:
    text = F.lower(F.btrim(F.regexp_replace(F.concat_ws("_", namespace, identifier), "[^a-zA-Z0-9_]+", "_"), F.lit("_")))
    text = F.when(text == "", F.lit("unknown")).otherwise(text)
    return F.substring(F.when(text.rlike("^[0-9]"), F.concat(F.lit("t_"), text)).otherwise(text), 1, SLUG_LENGTH)


def event_table(slug_text: str) -> str:
    return f"evt_{slug_text}"


def check_table_name(name: str) -> str:
    if not TABLE_NAME.fullmatch(name):
        raise ValueError(f"illegal table name: {name!r}")
    return name


def flat_columns(schema: T.StructType, prefix: str = "") -> dict[str, Column]:
    """The fields of nested structs by dotted paths, in order."""
    found: dict[str, Column] = {}
    for f in schema.fields:
        path = f"{prefix}`{f.name}`"
        found |= flat_columns(f.dataType, f"{path}.") if isinstance(f.dataType, T.StructType) else {path.replace("`", ""): F.col(path)}
    return found


def flatten(metrics: dict, prefix: str = "") -> dict:
    """Nested metrics as dotted paths."""
    found = {}
    for k, v in metrics.items():
        found |= flatten(v, f"{prefix}{k}.") if isinstance(v, dict) else {f"{prefix}{k}": v}
    return found
