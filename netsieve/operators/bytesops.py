"""Byte shaping: images, matrices, tokens, masks and field runs from hex text.

Bytes travel as hex text, two characters each, so cutting and padding are
string functions of the JVM. Arrays of numbers are made once, at the end, from
the text cut to the bytes that are needed, by one vectorised step a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

IMAGE, IMAGE_PAD = 784, 257
ROWS, HEADER, PAYLOAD = 5, 80, 240
TOKENS, PAD_TOKEN = 128, "0000"


#: The number that a character of hex text stands for, by its code; 0 for others.
DIGITS = np.zeros(256, np.uint8)
DIGITS[list(b"0123456789abcdef")] = range(16)
DIGITS[list(b"ABCDEF")] = range(10, 16)


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a batch of hex texts, one after the other, and where each text's begin and end."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    codes = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    lengths = np.diff(ends) // 2
    starts = np.concatenate(([0], np.cumsum(lengths)))
    if (np.diff(ends) % 2).any():  # an odd last character is no byte
        keep = np.ones(ends[-1] - ends[0], bool)
        keep[ends[1:][np.diff(ends) % 2 == 1] - 1 - ends[0]] = False
        digits = DIGITS[codes[ends[0] : ends[-1]][keep]]
    else:
        digits = DIGITS[codes[ends[0] : ends[-1]]]
    return digits[::2] * np.uint8(16) + digits[1::2], starts


def byte_values(text: Column, n: int) -> Column:
    """The first n bytes of hex text as numbers (fewer if there are fewer); none of null."""

    @F.arrow_udf("array<int>")
    def values(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found, starts = _bytes_of(texts)
            yield pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(found.astype(np.int32)))

    return values(F.substring(text, 1, 2 * n))


def image(text: Column, size: int = IMAGE, pad: int = IMAGE_PAD) -> Column:
    """size values in [0, 1]: bytes over 256, missing ones as the pad value over 256."""

    @F.arrow_udf("array<double>")
    def pixels(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found, starts = _bytes_of(texts)
            values = np.full((len(texts), size), pad / 256)
            lengths = np.diff(starts)
            row = np.repeat(np.arange(len(texts)), lengths)
            values[row, np.arange(len(found)) - starts[row]] = found / 256
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * size, pa.int32()), pa.array(values.ravel()))

    return pixels(F.substring(text, 1, 2 * size))


def _cut(text: Column, start: int | Column, n: int) -> Column:
    """n bytes of hex text from a byte on, zeros behind."""
    start = F.lit(start) if isinstance(start, int) else start
    return F.rpad(F.substr(text, start * 2 + 1, F.lit(2 * n)), 2 * n, "0")


def matrix(packets: Column, header_len: str = "header_len", raw: str = "raw") -> Column:
    """1600 byte values of the first five packets: 80 header and 240 payload bytes each, zeros for what is missing.

    packets: array of structs with hex text ``raw`` and the header's length in bytes.
    """
    def row(p: Column) -> Column:
        header = F.rpad(F.substr(p[raw], F.lit(1), F.least(F.lit(HEADER), p[header_len]) * 2), 2 * HEADER, "0")
        return F.concat(header, _cut(p[raw], p[header_len], PAYLOAD))

    some = F.transform(F.slice(packets, 1, ROWS), row)
    text = F.rpad(F.array_join(some, ""), 2 * ROWS * (HEADER + PAYLOAD), "0")
    return byte_values(text, ROWS * (HEADER + PAYLOAD))


def bigrams(text: Column, n: int = TOKENS, pad: str = PAD_TOKEN) -> Column:
    """n tokens of two neighbouring bytes each, overlapping by one, then pad tokens."""
    count = F.least(F.lit(n), F.greatest((F.length(text) / 2).cast("int") - 1, F.lit(0)))
    at = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    tokens = F.transform(at, lambda k: F.substr(text, k * 2 + 1, F.lit(4)))
    return F.concat(tokens, F.array_repeat(F.lit(pad), F.lit(n) - F.size(tokens)))


def masked(text: Column, spans: list[tuple[int | Column, int | Column]], value: str = "00") -> Column:
    """Hex text with bytes [start, end) of each span replaced; spans beyond its end are cut."""
    for start, end in spans:
        start, end = (F.lit(x) if isinstance(x, int) else x for x in (start, end))
        total = (F.length(text) / 2).cast("int")
        a, b = F.least(start, total), F.least(end, total)
        text = F.concat(F.substr(text, F.lit(1), a * 2), F.repeat(F.lit(value), F.greatest(b - a, F.lit(0))), F.substr(text, F.greatest(a, b) * 2 + 1))
    return text


def field_runs(rows: DataFrame, key: list[str], order: str, packet: str, field: str) -> DataFrame:
    """rows with ``byte_index``: the position (from 1) since field or packet last changed."""
    w = Window.partitionBy(*key).orderBy(order)
    changed = F.coalesce((F.col(packet) != F.lag(packet).over(w)) | (F.col(field) != F.lag(field).over(w)), F.lit(True))
    runs = rows.withColumn("_run", F.sum(changed.cast("int")).over(w))
    return runs.withColumn("byte_index", F.row_number().over(Window.partitionBy(*key, "_run").orderBy(order))).drop("_run")


def bigram_stream(packets: Column, n: int, raw: str = "raw", separator: str = "[SEP]", each: int = 63, most: int = 5) -> Column:
    """For each of the first packets a separator and ``each`` bigrams, as one array of at most n tokens."""
    rows = F.transform(F.slice(packets, 1, most), lambda p: F.concat(F.array(F.lit(separator)), bigrams(p[raw], each)))
    return F.slice(F.flatten(rows), 1, n)


def randomised(text: Column, spans: list[tuple[int, int]], *identity: Column) -> Column:
    """Hex text with the bytes of each span replaced by ones drawn from the session's identity.

    A session's copies of an identifier are replaced alike, other sessions' are
    not; spans beyond the end are cut, and lengths stay as they are.
    """
    seed = F.crc32(F.concat_ws("|", *identity)).cast("string")
    for start, end in spans:
        total = (F.length(text) / 2).cast("int")
        a, b = F.least(F.lit(start), total), F.least(F.lit(end), total)
        old = F.substr(text, a * 2 + 1, (b - a) * 2)
        drawn = F.repeat(F.md5(F.concat_ws("|", seed, old)), F.lit((end - start) // 16 + 1))
        text = F.concat(F.substr(text, F.lit(1), a * 2), F.substr(drawn, F.lit(1), (b - a) * 2), F.substr(text, b * 2 + 1))
    return text
