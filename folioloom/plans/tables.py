"""Tables of a folder, each delivered row once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = {
    "name_map": "entry_id", "chapters": "chapter_id", "sentences": "sentence_id", "paragraphs": "paragraph_id",
    "chapter_models": "model_id", "text_documents": "textdoc_id",
}


def load(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The columns asked for; tables with repeated deliveries have each key once."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    df = df.select(*columns) if columns else df
    key = KEYS.get(name)
    return df.dropDuplicates([key]) if key and key in df.columns else df


WEEK = ["Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday"]


def weekday(ts):
    return F.date_format(ts, "EEEE")
