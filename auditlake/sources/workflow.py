"""Workflow files: JSON documents of nodes, as tables of nodes and webhook handlers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODES = "nodes array<struct<name:string,type:string,typeVersion:double,parameters:map<string,string>>>, connections string"


def _doc() -> Column:
    return F.when(F.try_parse_json("text").isNotNull(), F.from_json("text", NODES))


def _is_workflow(doc: Column) -> Column:
    known = F.exists(doc["nodes"], lambda n: n["type"].rlike("^(n8n-nodes-base\\.|@n8n/)"))
    return F.coalesce(known & doc["connections"].isNotNull(), F.lit(False))


def parsed(files: DataFrame) -> DataFrame:
    """(file_path, doc, error, is_workflow) of (file_path, text); a text that is no JSON is an error row."""
    doc = F.col("doc")
    return files.select("file_path", _doc().alias("doc")).withColumns({"error": doc.isNull(), "is_workflow": _is_workflow(doc)})


def handlers(files: DataFrame) -> DataFrame:
    """(file_path, node, route, method, authentication) of a workflow's webhook nodes."""
    # a filter on the document would be pushed below it and parse each text again for every condition; within transform it is parsed once
    nodes = F.flatten(F.transform(F.array(_doc()), lambda d: F.when(_is_workflow(d), d["nodes"])))
    nodes = files.select("file_path", F.explode(nodes).alias("n")).where(F.lower("n.type").contains("webhook"))
    p = F.col("n.parameters")
    return nodes.select(
        "file_path",
        F.col("n.name").alias("node"),
        F.concat(F.lit("/"), F.regexp_replace(F.coalesce(p["path"], F.lit("")), "^/", "")).alias("route"),
        F.coalesce(p["httpMethod"], F.lit("POST")).alias("method"),
        F.coalesce(p["authentication"], F.lit("none")).alias("authentication"),
    )


def open_triggers(files: DataFrame) -> DataFrame:
    """Webhook nodes that anyone may call."""
    return handlers(files).where("authentication = 'none'")
