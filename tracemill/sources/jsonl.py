"""Line files of sessions, custom sessions, and findings files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def read_lines(spark: SparkSession, path: str, client: str) -> DataFrame:
    """client, source_path, source_offset (the line's number in its file, from 0), raw_json: lines that aren't blank.

    The numbers are the same in every read, however files are split: lines are counted for each
    split, and a line's number is its place in its split after all splits before it.  Byte offsets
    come from `tail.TailSource`.
    """
    split = F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("begin"))
    lines = spark.read.text(path).select(split.alias("split"), F.monotonically_increasing_id().alias("mark"), F.col("value").alias("raw_json"))
    counts = lines.groupBy("split").agg(F.min("mark").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("split.path").orderBy("split.begin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("split", (before - F.col("first")).alias("shift"))
    return lines.filter(F.trim("raw_json") != "").join(starts, "split").select(F.lit(client).alias("client"), F.col("split.path").alias("source_path"), (F.col("mark") + F.col("shift")).alias("source_offset"), "raw_json")


def valid(lines: DataFrame) -> DataFrame:
    """Lines that are JSON."""
    return lines.filter(F.expr("try_parse_json(raw_json)").isNotNull())


def read_custom_sessions(spark: SparkSession, path: str) -> DataFrame:
    """session_id, project, model, messages (JSON) of lines that have all three fields they need."""
    raw = spark.read.text(path)
    field = lambda name: F.get_json_object("value", f"$.{name}")
    folder = F.element_at(F.split(F.input_file_name(), "/"), -2)
    rows = raw.select(field("session_id").alias("session_id"), field("model").alias("model"), field("messages").alias("messages"), F.concat(F.lit("custom:"), folder).alias("project"))
    return rows.filter("session_id is not null and model is not null and messages is not null")


def read_findings(spark: SparkSession, path: str) -> DataFrame:
    """entity_text, entity_type, confidence of a findings file: a list, or an object with findings."""
    item = "array<struct<entity_text:string,entity_type:string,confidence:double>>"
    raw = spark.read.text(path, wholetext=True)
    listed = F.coalesce(F.get_json_object("value", "$.findings"), F.col("value"))
    return raw.select(F.explode(F.from_json(listed, item)).alias("f")).select("f.*")
