"""Graphs in JSON files: nodes and links (or edges), labels of communities, golden questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.functions import exprs as E

_LINKS = "array<struct<source:string,target:string,relation:string,weight:double>>"
GRAPH = f"nodes array<struct<id:string,label:string,file_type:string,source_file:string,source_location:string,community:string>>, links {_LINKS}, edges {_LINKS}"


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """nodes and links of a file, or of all files of a folder (one task reads a file). Other keys are ignored; missing
    and null texts are empty; edges stand in where links are missing or empty. Links keep their dangling ends."""
    raw = spark.read.schema(GRAPH).option("multiLine", True).json(path)
    nodes = raw.select(F.inline("nodes")).where("id is not null")
    texts = [E.strip_control(E.text(F.col(c))).alias(c) for c in ("id", "label", "file_type", "source_file", "source_location")]
    links = raw.select(F.inline(F.when(F.size("links") > 0, F.col("links")).otherwise(F.col("edges"))))
    return nodes.select(*texts, "community"), links


def with_communities(nodes: DataFrame, path: str | None) -> DataFrame:
    """Adds community_label from a JSON map of community to label; empty where unknown or without a file."""
    if path is None:
        return nodes.withColumn("community_label", F.lit(""))
    labels = nodes.sparkSession.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("community", "community_label"))
    return nodes.join(labels, "community", "left").withColumn("community_label", E.text(F.col("community_label")))


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """q, expect: questions and lower-cased parts of the paths or names they should find."""
    rows = spark.read.schema("q string, expect array<string>").option("multiLine", True).json(path)
    return rows.select("q", F.transform("expect", F.lower).alias("expect"))
