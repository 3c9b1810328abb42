"""Files beside archives (S13-S20, S22-S24) and the record of a document."""

from __future__ import annotations

import os
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioloom.operators.ranks import bounded_rows


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON file under a declared schema; a file that doesn't fit is an error."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_assigned(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """The JSON that a script assigns to window.<name>."""
    raw = spark.read.text(path, wholetext=True)
    body = F.regexp_extract("value", rf"(?s)window\.{name}\s*=\s*(\{{.*\}})\s*;", 1)
    return raw.select(F.when(body == "", F.raise_error(F.lit(f"no window.{name}"))).otherwise(F.from_json(body, schema, {"mode": "FAILFAST"})).alias("data")).select("data.*")


def read_lines(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """(file, line_no, text) of small line files, from 1."""
    parts = []
    for name, path in paths.items():
        whole = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", r"\R$", ""), r"\R")).alias("k", "text"))
        parts.append(whole.select(F.lit(name).alias("file"), (F.col("k") + 1).alias("line_no"), "text"))
    return reduce(DataFrame.unionByName, parts)


def lines_side_by_side(lines: DataFrame, files: list[str]) -> DataFrame:
    """(line_no, one column for each file)."""
    return lines.groupBy("line_no").pivot("file", files).agg(F.first("text"))


def resolve_paths(versions: DataFrame, local: Mapping[str, str], environment: Mapping[str, str] | None = None) -> DataFrame:
    """(id, path, exists_path): the stated path, else the environment's, else the local one."""
    env = os.environ if environment is None else environment
    rows = bounded_rows(versions.select("id", "source_path", "source_path_env"), 100_000, "the catalogue of editions")
    found = []
    for r in rows:
        path = r.source_path or (env.get(r.source_path_env) if r.source_path_env else None) or local.get(r.id)
        found.append((r.id, path, bool(path) and os.path.exists(path)))
    return versions.sparkSession.createDataFrame(found, "id string, path string, exists_path boolean")


def by_source_type(versions: DataFrame, known: tuple[str, ...] = ("repo-data", "epub", "pdf")) -> DataFrame:
    """The reader of each version, and a warning for a type that has none."""
    ok = F.col("source_type").isin(*known)
    return versions.withColumn("reader", F.when(ok, F.col("source_type"))).withColumn("warning", F.when(~F.coalesce(ok, F.lit(False)), F.concat(F.lit("unsupported_source_type:"), F.coalesce("source_type", F.lit("")))))


def grouped_by_chapter(rows: DataFrame, chapter: str, order: str, text: str) -> DataFrame:
    """(chapter, blocks) with the texts in input order."""
    return rows.groupBy(chapter).agg(F.sort_array(F.collect_list(F.struct(order, text))).alias("b")).select(chapter, F.col(f"b.{text}").alias("blocks"))


def char_count(blocks: Column) -> Column:
    """The length of the blocks joined by line breaks."""
    return F.length(F.array_join(blocks, "\n"))


def document_records(documents: DataFrame, by: str, order: str) -> DataFrame:
    """With char_count and the place in the list as chapter_order."""
    return documents.withColumn("chapter_order", F.row_number().over(Window.partitionBy(by).orderBy(order))).withColumn("char_count", char_count(F.col("blocks")))


def body_documents(documents: DataFrame, by: str, order: str, chapter: Column, least: int = 5000, chapters: int = 20) -> DataFrame:
    """the documents that make up the body.

    Long ones that aren't covers and the like; if each chapter number has one, the first of
    each; else the first `chapters` of them, or all if they are fewer.
    """
    w, first = Window.partitionBy(by), Window.partitionBy(by, "_c").orderBy(order)
    c = documents.where((F.col("char_count") >= least) & ~F.lower("href").rlike("(cover|nav|toc|copyright|titlepage)"))
    c = c.withColumn("_c", F.when(chapter.between(1, chapters), chapter)).withColumn("_k", F.row_number().over(first)).withColumn("_n", F.row_number().over(w.orderBy(order)))
    c = c.withColumn("_have", F.size(F.collect_set("_c").over(w)))
    keep = F.when(F.col("_have") >= chapters, F.col("_c").isNotNull() & (F.col("_k") == 1)).otherwise(F.col("_n") <= F.greatest(F.lit(chapters), F.lit(0)))
    return c.where(keep).drop("_c", "_k", "_n", "_have")


def chapter_metrics(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Characters and rows of a chapter, at least 1 each."""
    return rows.groupBy(*keys).agg(F.greatest(F.lit(1), F.sum(F.length(text))).alias("chars"), F.greatest(F.lit(1), F.count(F.lit(1))).alias("rows"))


def stored_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stored table, or an empty one if there is none; one that can't be read is an error."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(where):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)
