"""Sources and sinks: raw archives, text files, sheets as CSV, fingerprints, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FIELDS = ("title", "url", "date_text", "activity_date", "activity_date_end", "source", "source_url", "collected_at", "description")
ARCHIVE = "source_url string, collected_at string, raw_file string, records array<struct<" + ",".join(f"{f}:string" for f in FIELDS) + ">>"


def raw_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Records of all JSON archives of a folder but ``metadata.json``; corrupt files are skipped, and records inherit what their archive states."""
    files = spark.read.schema(ARCHIVE).option("multiLine", True).option("mode", "DROPMALFORMED").option("recursiveFileLookup", False).json(f"{folder}/*.json")
    files = files.where(~F.col("_metadata.file_name").eqNullSafe("metadata.json"))
    each = files.select("source_url", "collected_at", F.explode("records").alias("r"))
    inherited = {c: F.coalesce(F.col(f"r.{c}"), F.col(c)) for c in ("source_url", "collected_at")}
    return each.select(*(inherited.get(f, F.col(f"r.{f}")).alias(f) for f in FIELDS))


def sheet_rows(spark: SparkSession, path: str, sheet: str) -> DataFrame:
    """Rows of a sheet kept as CSV without header: (sheet, row, text, url); the URL is the first cell after the first that begins with http."""
    raw = spark.read.option("header", False).option("multiLine", True).csv(path)
    cells = F.array(*(F.trim(F.col(c)) for c in raw.columns))
    numbered = raw.select(cells.alias("cells")).withColumn("row", F.row_number().over(Window.orderBy(F.monotonically_increasing_id())))  # one sheet
    first = numbered.agg(F.max(F.when((F.col("row") <= 3) & F.coalesce(F.lower(F.col("cells")[0]) == "post title", F.lit(False)), F.col("row"))).alias("header"))
    body = numbered.crossJoin(first).where(F.col("row") > F.coalesce("header", F.lit(0)))  # by one row
    url = F.filter(F.slice("cells", 2, F.greatest(F.size("cells") - 1, F.lit(0))), lambda c: c.startswith("http"))
    kept = body.where(F.coalesce(F.col("cells")[0], F.lit("")) != "")
    return kept.select(F.lit(sheet).alias("sheet"), "row", F.col("cells")[0].alias("text"), F.get(url, F.lit(0)).alias("url"))


def text_archive(spark: SparkSession, folder: str) -> DataFrame:
    """(path, body) of text or HTML files, each whole."""
    return spark.read.text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"))


def fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, sha256) of files."""
    return spark.read.format("binaryFile").load(folder).select("path", "length", F.sha2("content", 256).alias("sha256"))


def write_metrics(df: DataFrame, folder: str) -> None:
    """The same metrics as JSON and as flat CSV."""
    df.write.mode("overwrite").json(f"{folder}/json")
    df.write.mode("overwrite").option("header", True).csv(f"{folder}/csv")


def write_sheets(sheets: dict[str, DataFrame], folder: str) -> None:
    """Several tables, one CSV folder each."""
    for name, df in sheets.items():
        df.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")


def numbered_report(df: DataFrame, order: list[str], by: str | None = None) -> DataFrame:
    """``df`` with a serial number first, for each value of ``by``."""
    window = Window.partitionBy(by) if by else Window.partitionBy(F.lit(1))
    return df.select(F.row_number().over(window.orderBy(*order)).alias("s_no"), *df.columns)
