"""Schemas of records, issues and merged sites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ADDRESS = "struct<full:string,street:string,suburb:string,state:string,postcode:string>"
CONNECTORS = "array<struct<standard:string,count:int,power_kw:double>>"
#: name -> type of a record, in order.
RECORD = {
    "rid": "bigint", "source_id": "string", "source_record_id": "string", "source_url": "string", "fetched_at": "timestamp",
    "lat": "double", "lng": "double", "name": "string", "name_from_operator": "boolean", "operator": "string", "network": "string",
    "address": ADDRESS, "connectors": CONNECTORS, "plug_count": "int", "max_power_kw": "double", "status": "string", "access": "string",
    "fee": "boolean", "opening_hours": "string", "website": "string", "geocoded": "boolean", "position_precision": "string", "extra": "map<string,string>",
}
ISSUE = {"source_id": "string", "source_record_id": "string", "kind": "string", "issue": "string"}
ISSUE_KINDS = ("rejected", "parse_failure", "data_gap", "status_flag", "policy")
#: Kinds that point at a broken source rather than at gaps in its data.
STRUCTURAL = ("rejected", "parse_failure")


def struct_of(fields: dict[str, str]) -> T.StructType:
    return T.StructType([T.StructField(k, T._parse_datatype_string(v)) for k, v in fields.items()])


def conform(df: DataFrame, fields: dict[str, str] = RECORD) -> DataFrame:
    """The columns of ``fields`` in order; missing ones are null, other ones go."""
    have = set(df.columns)
    return df.select(*[(F.col(k) if k in have else F.lit(None)).cast(v).alias(k) for k, v in fields.items()])
