"""Markdown files and folders, conversation files, the markdown sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import checkpointed
from ..functions.markdown import markdown_chunks


def markdown(spark: SparkSession, path: str) -> DataFrame:
    """path, chunk, content, source: the chunks of a file, or of every *.md below a folder. A missing path raises, as any Spark source."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(path, wholetext=True)
    rows = files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("source"), F.posexplode(markdown_chunks(F.col("value"))).alias("chunk", "content"))
    return rows.select("path", "chunk", "content", "source")


def placed(rows: DataFrame) -> DataFrame:
    """The chunks with their position over all files, in the order of paths: files are few against chunks, and only their paths are ordered (by ranges, in parallel)."""
    spark = rows.sparkSession
    paths = rows.select("path").distinct().repartitionByRange("path").sortWithinPartitions("path").withColumn("_at", F.monotonically_increasing_id())
    paths = checkpointed(paths)
    counts = paths.groupBy(F.shiftright("_at", 33).cast("int").alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()  # a row a partition
    base, total = [], 0
    for row in counts:
        base.append((row["part"], total))
        total += row["n"]
    bases = spark.createDataFrame(base, "_part int, _base long")
    numbers = paths.join(F.broadcast(bases), F.shiftright("_at", 33).cast("int") == F.col("_part")).select("path", (F.col("_base") + F.col("_at").bitwiseAND((1 << 33) - 1)).alias("_number"))
    return rows.join(numbers, "path").withColumn("position", F.shiftleft("_number", 32) + F.col("chunk")).drop("_number", "path", "chunk")


def conversation(spark: SparkSession, path: str) -> DataFrame:
    """run, message, role, content of a JSON file: a list of messages, or an object with such a list under `messages`."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("run"), F.col("value"))
    kind = "array<struct<role:string,content:string>>"
    either = F.coalesce(F.when(F.ltrim("value").startswith("["), F.from_json("value", kind)), F.from_json("value", f"struct<messages:{kind}>")["messages"])
    return raw.select("run", F.posexplode(either).alias("message", "m")).select("run", "message", "m.role", "m.content")


def write_markdown(blocks: DataFrame, path: str, title: str = "# Agent Memory Export\n") -> None:
    """Sorted export blocks as text files: one after another, in the order of their names, they are the document."""
    spark = blocks.sparkSession
    head = spark.createDataFrame([(-1, 0.0, -1, title)], "tier_order int, created_at double, id long, text string")
    head.unionByName(blocks).orderBy("tier_order", "created_at", "id").select("text").write.mode("overwrite").text(path)
