"""Text sources and sinks: extracted packet fields, flow logs, session tables as CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netsieve.schemas import FIELDS, PACKETS


def packet_fields(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated packet fields, with filename and class_name (its folder) from the path; empty text stays empty."""
    rows = spark.read.csv(path, sep="\t", schema=PACKETS, quote="", nullValue="\u0000", emptyValue="")
    parts = F.split(F.input_file_name(), "/")
    return rows.select(F.element_at(parts, -1).alias("filename"), F.element_at(parts, -2).alias("class_name"), *[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in FIELDS])


def flow_log(spark: SparkSession, path: str, least: int = 8) -> DataFrame:
    """Flow logs in Latin-1: positions 1 to 6 and the last; header and rows of under ``least`` fields are left out."""
    lines = spark.read.csv(path, schema="line string", sep="\u0001", quote="", encoding="ISO-8859-1")
    cells = F.split("line", ",")
    names = ("src_ip", "src_port", "dst_ip", "dst_port", "protocol", "time")
    rows = lines.where(F.size(cells) >= least).select(*[F.trim(F.get(cells, F.lit(k + 1))).alias(n) for k, n in enumerate(names)], F.trim(F.element_at(cells, -1)).alias("label"))
    return rows.where(F.col("src_port").rlike(r"^\d+$"))


def sessions(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Session tables as CSV with a header; every column is text and empty text stays empty."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    rows = spark.read.csv(path, header=True, schema=schema, nullValue="\u0000", emptyValue="", enforceSchema=False)
    return rows.fillna("")


def write_chunked(df: DataFrame, path: str, rows: int = 500_000, missing: str = "-") -> None:
    """CSV parts of at most ``rows`` rows; nulls become the missing mark."""
    text = df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(missing)).alias(c) for c in df.columns])
    text.write.mode("overwrite").option("header", True).option("maxRecordsPerFile", rows).option("emptyValue", "").csv(path)


def unread(spark: SparkSession, files: DataFrame, manifest: DataFrame, name: str = "filename") -> DataFrame:
    """Files that the manifest of finished ones lacks."""
    return files.join(manifest.select(name).distinct(), name, "left_anti")


def finished(rows: DataFrame, manifest: DataFrame, name: str = "filename") -> DataFrame:
    """Rows of files in the manifest: those that a broken run left of other files are gone."""
    return rows.join(manifest.select(name).distinct(), name, "left_semi")


def read_label_map(spark: SparkSession, path: str) -> DataFrame:
    """(label, id) of a label map, one JSON object of a file; a map has one entry a class."""
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string, int>").alias("m"))
    return text.select(F.explode("m").alias("label", "id"))


def write_label_map(labels: DataFrame, path: str) -> None:
    """A label map as one JSON object, in the order of its ids."""
    entries = labels.agg(F.array_sort(F.collect_list(F.struct("id", "label"))).alias("e"))
    texts = F.transform("e", lambda x: F.concat(F.regexp_extract(F.to_json(F.array(x["label"])), r"(?s)^\[(.*)\]$", 1), F.lit(": "), x["id"].cast("string")))
    entries.select(F.concat(F.lit("{"), F.array_join(texts, ", "), F.lit("}")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_errors(rows: DataFrame, path: str, name: str = "path", reason: str = "reason") -> None:
    """Append (path, reason) of inputs that could not be read, as tab-separated text."""
    rows.select(F.concat_ws("\t", name, F.regexp_replace(reason, r"[\t\r\n]+", " ")).alias("value")).write.mode("append").text(path)
