"""Tool catalogues: nested JSON to rows, grouped by domain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "array<struct<domain:string,tools:array<struct<name:string,description:string,parameters:struct<properties:map<string,struct<type:string>>,required:array<string>>>>>>"


def flatten(rows: DataFrame, column: str = "json") -> DataFrame:
    """pos, domain, name, description and arguments (`name:type`, required first, then by name); tools without name or description are left out.

    Invalid JSON gives no rows; the default domain is general, the default type any.
    """
    groups = rows.select(F.from_json(column, SCHEMA).alias("c")).select(F.posexplode("c").alias("g", "d"))
    tools = groups.select("g", F.coalesce("d.domain", F.lit("general")).alias("domain"), F.posexplode("d.tools").alias("t", "tool"))
    optional = F.transform(
        F.coalesce(F.map_entries("tool.parameters.properties"), F.expr("cast(array() as array<struct<key:string,value:struct<type:string>>>)")),
        lambda e: F.struct((~F.array_contains(F.coalesce(F.col("tool.parameters.required"), F.array().cast("array<string>")), e["key"])).alias("o"), e["key"].alias("k"), F.coalesce(e["value"]["type"], F.lit("any")).alias("t")),
    )
    arguments = F.array_join(F.transform(F.array_sort(optional), lambda s: F.concat(s["k"], F.lit(":"), s["t"])), ",")
    out = tools.where("tool.name is not null and tool.description is not null")
    return out.select((F.col("g") * 100_000 + F.col("t")).cast("long").alias("pos"), "domain", F.col("tool.name").alias("name"), F.col("tool.description").alias("description"), arguments.alias("arguments"))


def grouped(flat: DataFrame) -> DataFrame:
    """position (of the domain, by first appearance), domain and its tools in order."""
    g = flat.groupBy("domain").agg(F.min("pos").alias("position"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda s: s["name"]), ",").alias("tools"))
    return g.select("position", "domain", "tools").orderBy("position")
