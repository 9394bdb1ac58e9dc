"""Readers: tolerant JSON lines, whole files keyed by path, delimited texts, torn CSV, archives."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.sources.pieces import records

# --- fixed values: schemas and file-name forms ------------------------------
RECORD_SCHEMA = "model string, matter string, condition string, kind string, verdict string, citation string, reporter string"
EVENT_SCHEMA = "ts double, step string, type string, data string"
METER_SCHEMA = (
    "ts double, client string, model string, tag string, in_tokens long, out_tokens long, est_cost double, latency_ms long"
)
NOTE_SCHEMA = "op string, id string, seq int, case_id string, text string, meta string, reason string"
DRAFT_NAME = r"([^/]+)/drafts/([^/]+)_([a-z]+)\.txt$"
REVISION_NAME = r"([^/]+)/drafts/([^/]+)_([a-z]+)_r(\d+)\.txt$"
US_CITE = r"(\d+)\s+U\.?S\.?\s+(\d+)"
ROW_START = r'^"\d{1,10}","\d{4}-\d{2}-\d{2} '
ROW_COLUMNS = {0: "id", 8: "case_name", 4: "date_filed", 10: "scdb_id", 33: "docket_id"}
ROW_WIDTH = 34
REPORT_LINE = r"^- \*\*([a-z_]+)\*\* \| (\S+) (\S+)_([a-z]+) \| cited (.+?) \((.*?)\) \| true source: (.*)$"
# ----------------------------------------------------------------------------


def exists(spark: SparkSession, path: str) -> bool:
    """Does a path or glob match anything on its file system?"""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = jpath.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(jpath)
    return found is not None and len(found) > 0


def read_or_empty(spark: SparkSession, path: str, schema: str, reader) -> DataFrame:
    """A missing source is an empty table of the same schema."""
    return reader(path) if exists(spark, path) else spark.createDataFrame([], schema)


def csv_columns(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Compressed CSV with a header (bz2 splits), pruned to the wanted columns at the scan."""
    return spark.read.option("header", True).option("maxCharsPerColumn", -1).csv(path).select(*columns)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; torn or corrupt lines are dropped, keys the schema lacks are ignored."""
    wide = T._parse_datatype_string(schema).add("_corrupt", T.StringType())
    raw = spark.read.schema(wide).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return raw.filter(F.col("_corrupt").isNull()).drop("_corrupt")


def drafts(spark: SparkSession, path: str) -> DataFrame:
    """Draft files with model, matter and condition taken from the path."""
    raw = spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())
    part = lambda i: F.regexp_extract("path", DRAFT_NAME, i)
    return raw.filter(F.col("path").rlike(DRAFT_NAME)).select(
        part(1).alias("model"), part(2).alias("matter"), part(3).alias("condition"), F.col("value").alias("text")
    )


def revisions(spark: SparkSession, path: str) -> DataFrame:
    """Revision files with the round number as an integer, so that round 10 follows round 9."""
    raw = spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())
    part = lambda i: F.regexp_extract("path", REVISION_NAME, i)
    return raw.filter(F.col("path").rlike(REVISION_NAME)).select(
        part(1).alias("model"), part(2).alias("matter"), part(3).alias("arm"), part(4).cast("int").alias("round"),
        F.col("value").alias("text"),
    )


def keyed_tree(spark: SparkSession, path: str) -> DataFrame:
    """``volume_reporter_page.txt`` (or ``volume_page.txt``, U.S. Reports) files as keyed texts."""
    raw = spark.read.text(path, wholetext=True)
    stem = F.regexp_extract(F.input_file_name(), r"([^/]+)\.txt$", 1)
    parts = F.split(stem, "_")
    keyed = raw.select(parts.alias("p"), F.col("value").alias("text"))
    three = F.size("p") == 3
    return keyed.filter(F.size("p").isin(2, 3)).select(
        F.col("p")[0].alias("volume"), F.when(three, F.upper(F.get("p", F.lit(1)))).otherwise("US").alias("reporter_norm"),
        F.when(three, F.get("p", F.lit(2))).otherwise(F.get("p", F.lit(1))).alias("page"), "text",
    )


def labelled_texts(spark: SparkSession, labels: str, texts: str) -> DataFrame:
    """Texts keyed by the U.S. Reports citation that a label file in the same directory carries."""
    folder = F.regexp_extract(F.input_file_name(), r"^(.*)/[^/]+$", 1)
    lab = spark.read.schema("citation string").option("multiLine", True).json(labels).select(folder.alias("dir"), "citation")
    txt = spark.read.text(texts, wholetext=True).select(folder.alias("dir"), F.col("value").alias("text"))
    keyed = lab.filter(F.col("citation").rlike(US_CITE)).select(
        "dir", F.regexp_extract("citation", US_CITE, 1).alias("volume"), F.lit("US").alias("reporter_norm"),
        F.regexp_extract("citation", US_CITE, 2).alias("page"),
    )
    return keyed.join(txt, "dir").drop("dir")


def delimited(spark: SparkSession, path: str, separator: str = "\n--- ", shortest: int = 200) -> DataFrame:
    """A mega-text cut at a separator by the reader itself, with a caption for each chunk."""
    raw = spark.read.option("lineSep", separator).text(path).filter(F.length("value") >= shortest)
    named = F.regexp_extract("value", r"^\[?\s*([^\]\n]{3,120})\]", 1)
    caption = F.when(named != "", F.trim(named)).otherwise(F.trim(F.left("value", F.lit(80))))
    return raw.select(F.left(caption, F.lit(90)).alias("caption"), F.col("value").alias("text"))


def parse_report_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Bulleted report lines back to columns; other lines are dropped."""
    part = lambda i: F.regexp_extract(column, REPORT_LINE, i)
    return lines.filter(F.col(column).rlike(REPORT_LINE)).select(
        part(1).alias("cls"), part(2).alias("model"), part(3).alias("matter"), part(4).alias("condition"),
        part(5).alias("citation"), part(6).alias("attributed_name"), part(7).alias("sources"),
    )


def _starts(lines: list[bytes]) -> list[bool]:
    return [re.match(ROW_START.encode(), line) is not None for line in lines]


def torn_csv(spark: SparkSession, path: str, longest: int = 1 << 24) -> DataFrame:
    """CSV rows whose quoting is broken, each parsed alone from one row start to the next.

    A line that looks like the start of a row opens a record. A row that does not parse to enough columns is
    dropped, and cannot swallow the rows after it; nor can one over ``longest`` bytes, which is cut.
    """
    fields = ", ".join(f"c{i} string" for i in range(ROW_WIDTH))
    text = F.decode("data", "utf-8")
    row = F.from_csv(text, f"{fields}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", "multiLine": "true", "maxCharsPerColumn": "-1"})
    parsed = records(spark, path, _starts, longest=longest).select(row.alias("r")).filter(
        F.col("r._bad").isNull() & F.col("r.c33").isNotNull() & F.col("r.c0").rlike(r"^\d+$") & F.col("r.c33").rlike(r"^\d*$")
    )
    typed = {"id": "long", "docket_id": "long"}
    return parsed.select(*[F.col(f"r.c{i}").cast(typed.get(n, "string")).alias(n) for i, n in ROW_COLUMNS.items()])


def clean_excerpts(rows: DataFrame) -> DataFrame:
    """Benchmark excerpts from real filings: PDF sources whose map of planted errors is empty."""
    return rows.filter(F.col("filename").endswith(".pdf") & (F.coalesce(F.size("list_hallucinations"), F.lit(0)) <= 0))
