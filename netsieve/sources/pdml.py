"""Dissection files (PDML) to one row for each byte: the name of the smallest field that covers it."""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "filename string, frame int, pos int, field string"
ARROW = pa.schema([("filename", pa.string()), ("frame", pa.int32()), ("pos", pa.int32()), ("field", pa.string())])
PAD = "<pad>"


def byte_fields(packet: ElementTree.Element) -> dict[int, str]:
    """Position to field name; of fields of one size the one that comes first."""
    best: dict[int, tuple[int, str]] = {}
    for field in packet.iter():
        if field.tag not in ("field", "proto") or not field.get("name") or field.get("pos") is None:
            continue
        start, size = int(field.get("pos", "0")), int(field.get("size", "0"))
        for pos in range(start, start + size):
            if pos not in best or size < best[pos][0]:
                best[pos] = (size, field.get("name", ""))
    return {pos: name for pos, (_, name) in sorted(best.items())}


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name, content in zip(batch.column(0), batch.column(1), strict=True):
            parser = ElementTree.XMLPullParser(["end"])
            data, frame = content.as_py() or b"", 0
            for at in range(0, len(data), 1 << 20):
                try:
                    parser.feed(data[at : at + (1 << 20)])
                    found = [e for _, e in parser.read_events() if e.tag == "packet"]
                except ElementTree.ParseError:  # what came before a damaged end is kept
                    break
                for packet in found:
                    frame += 1
                    rows = [{"filename": name.as_py(), "frame": frame, "pos": pos, "field": field} for pos, field in byte_fields(packet).items()]
                    packet.clear()
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema=ARROW)


def read(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("filename"), "content")
    return files.mapInArrow(_rows, SCHEMA)


def vocabulary(rows: DataFrame, field: str = "field") -> DataFrame:
    """(field, field_id) by name from 1 on; 0 is padding. One row a field name, so small by nature."""
    from pyspark.sql.window import Window

    names = rows.select(field).where(F.col(field) != PAD).distinct()
    numbered = names.select(field, F.row_number().over(Window.orderBy(field)).alias("field_id"))
    return numbered.unionByName(rows.sparkSession.createDataFrame([(PAD, 0)], f"{field} string, field_id int"))


def equality_rate(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row: positions of both, and the share at which they agree."""
    both = a.select(*keys, F.col(value).alias("_a")).join(b.select(*keys, F.col(value).alias("_b")), keys)
    return both.agg(F.count("*").alias("n"), F.avg((F.col("_a") == F.col("_b")).cast("int")).alias("equal"))
