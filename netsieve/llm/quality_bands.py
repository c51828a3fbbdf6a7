"""Quality rules: compression bands over whole documents and fixed chunks.

A text is compressed whole and in fixed chunks with zstandard. Repetitive text
compresses to far less of its size than prose of the same length, and encoded
or random data to far more, so each length has its own band of allowed ratios
(compressed bytes / UTF-8 bytes). The base counts come from the same pass.

The bands of ``Bands`` are wide enough for prose of any language and stop only
coarse junk. ``fit`` narrows them to a corpus: from all rows labelled as good
it takes, for each class of lengths (two to each doubling), the ratios that all
but a small share of those rows keep to, and a margin. Classes with few
labelled rows keep the wide band.

Judging is a function of one text: no shuffle, no state, one text in memory
beside its words. Defined results: a null text counts as empty (all counts 0,
``base_failed`` true, ``kept`` false); repeated rows give repeated results;
other columns of the input are neither read nor returned. With no labels, or
none for the rows there are, the wide bands hold; null ids have no label; a
label given twice counts once, and as good only if it is so each time.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netsieve.llm.shared import Tables, release, text_batches

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Bands:
    """Allowed ratios by length: (bytes below, least ratio, greatest ratio).

    A frame costs zstandard about 12 bytes and short texts share little, so
    the band of short texts reaches above 1; longer texts find more matches,
    so both limits fall with the length. Text coded in 64 characters cannot
    fall under 0.75, which is above the limits of longer texts. Chunks all have one length and one
    band; a text fails if more than ``bad_chunks`` of its chunks leave it.
    """

    whole: tuple[tuple[float, float, float], ...] = (
        (512, 0.35, 1.10),
        (2048, 0.28, 0.85),
        (8192, 0.22, 0.73),
        (65536, 0.18, 0.70),
        (float("inf"), 0.15, 0.70),
    )
    chunk_bytes: int = 4096
    chunk: tuple[float, float] = (0.22, 0.73)
    bad_chunks: float = 0.25
    level: int = 3


@dataclass(frozen=True)
class Fit:
    """Labelled rows at most (none: all), those that a class needs, share of good rows that may lie under or over a limit, and the margin beyond."""

    rows: int | None = None
    least: int = 50
    share: float = 0.002
    margin: float = 0.01


RESULT = pa.struct(
    [
        ("n_words", pa.int64()),
        ("word_chars", pa.int64()),
        ("n_symbols", pa.int64()),
        ("n_dup_lines", pa.int64()),
        ("n_repeat_words", pa.int64()),
        ("base_failed", pa.bool_()),
        ("kept", pa.bool_()),
        ("ratio", pa.float64()),
        ("n_chunks", pa.int64()),
        ("n_bad_chunks", pa.int64()),
    ]
)
RESULT_DDL = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, ratio double, n_chunks long, n_bad_chunks long"
)


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a 3-word window which the text holds twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    times, covered, n = Counter(windows), 0, 0
    for at, window in enumerate(windows):
        if times[window] > 1:
            n += at + 3 - max(at, covered)
            covered = at + 3
    return n


def duplicate_lines(text: str) -> int:
    seen: set[str] = set()
    n = 0
    for line in text.split("\n"):
        if line.strip(BLANKS):
            n += line in seen
            seen.add(line)
    return n


def chunks(raw: bytes, size: int) -> list[bytes]:
    """Fixed chunks; a last one of under half the size is left to the whole-text ratio."""
    return [raw[at : at + size] for at in range(0, len(raw), size) if at == 0 or len(raw) - at >= size // 2]


def chunk_ratios(raw: bytes, size: int, press: zstandard.ZstdCompressor) -> list[float]:
    """The ratios of a text's chunks; none for a text of one chunk."""
    return [len(press.compress(x)) / len(x) for x in chunks(raw, size)] if len(raw) > size else []


def limits(bands: Bands, size: float) -> tuple[float, float]:
    return next((least, most) for below, least, most in bands.whole if size < below)


def measure(text: str | None, bands: Bands, press: zstandard.ZstdCompressor) -> tuple:
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes split at exactly the blanks 0x20 and 0x09-0x0D
    n_words = len(words)
    repeat = repeated_words(words)
    failed = n_words < 50 or 100 * repeat > 50 * n_words
    ratio = len(press.compress(raw)) / len(raw) if raw else 0.0
    pieces = chunk_ratios(raw, bands.chunk_bytes, press)
    bad = sum(not bands.chunk[0] <= x <= bands.chunk[1] for x in pieces)
    least, most = limits(bands, len(raw))
    kept = not failed and least <= ratio <= most and bad <= bands.bad_chunks * len(pieces)
    return (
        n_words,
        len(text) - sum(map(text.count, BLANKS)),
        sum(map(text.count, SYMBOLS)),
        duplicate_lines(text),
        repeat,
        failed,
        kept,
        ratio,
        len(pieces),
        bad,
    )


def quality(text: Column | str, bands: Bands | None = None) -> Column:
    """A struct of the counts and the verdict for a text column."""
    bands = bands or Bands()

    @F.arrow_udf(RESULT_DDL)
    def judged(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        press = zstandard.ZstdCompressor(level=bands.level)
        for texts in batches:
            rows = [measure(t.as_py(), bands, press) for t in texts]
            columns = zip(*rows, strict=True) if rows else [()] * len(RESULT)
            yield pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, RESULT, strict=True)], fields=list(RESULT))
            release()

    return judged(F.col(text) if isinstance(text, str) else text)


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: Bands | None = None) -> DataFrame:
    """One row per input row: the id and the fields of ``quality``."""
    text_batches(docs.sparkSession)
    return docs.select(F.col(id_col), quality(text_col, bands).alias("_quality")).select(id_col, "_quality.*")


def keep_clean(docs: DataFrame, text_col: str = "text", bands: Bands | None = None) -> DataFrame:
    """The rows that pass, with all their columns."""
    text_batches(docs.sparkSession)
    return docs.where(quality(text_col, bands)["kept"])


def _ratios(bands: Bands):
    """A column function: bytes and ratio of a text that passes the base rules, and the least and greatest ratio of its chunks."""

    @F.arrow_udf("bytes long, ratio double, low double, high double")
    def ratios(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        press = zstandard.ZstdCompressor(level=bands.level)
        for texts in batches:
            rows = []
            for text in texts:
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                words = raw.split()
                if len(words) < 50 or 100 * repeated_words(words) > 50 * len(words):
                    rows.append(None)
                    continue
                parts = chunk_ratios(raw, bands.chunk_bytes, press)
                rows.append({"bytes": len(raw), "ratio": len(press.compress(raw)) / len(raw), "low": min(parts, default=None), "high": max(parts, default=None)})
            yield pa.array(rows, pa.struct([("bytes", pa.int64()), ("ratio", pa.float64()), ("low", pa.float64()), ("high", pa.float64())]))
            release()

    return ratios


#: Cells that a range of values is cut into at once.
CELLS = 1024


def quantiles(values: DataFrame, shares: tuple[float, ...]) -> dict[int, tuple[int, list[float]]]:
    """By series, how many values (series int, value double) has and the exact quantiles, those of ``F.percentile``.

    The range that holds a wanted rank is cut into cells, which are counted;
    the rank's cell is the next range, until all its values are equal. So no
    task holds a series, and what reaches the driver is counts of cells.
    values is read once a round and should be a written table.
    """
    spark = values.sparkSession
    series = {r["series"]: r for r in values.groupBy("series").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high")).collect()}
    place = {(k, f((r["n"] - 1) * q)): (r["low"], r["high"], 0) for k, r in series.items() for q in shares for f in (math.floor, math.ceil)}
    while wide := sorted({(k, low, high) for (k, _), (low, high, _) in place.items() if low < high}):
        ranges = F.broadcast(spark.createDataFrame(wide, "series int, low double, high double"))
        cell = F.floor((F.col("value") - F.col("low")) / (F.col("high") - F.col("low")) * CELLS).alias("cell")
        held = values.join(ranges, "series").where("value BETWEEN low AND high").groupBy("series", "low", "high", cell)
        cells: dict[tuple, list] = {}
        for r in sorted(held.agg(F.count("*").alias("n"), F.min("value").alias("first"), F.max("value").alias("last")).collect(), key=lambda r: r["cell"]):
            cells.setdefault((r["series"], r["low"], r["high"]), []).append(r)
        for (k, rank), (low, high, before) in place.items():
            for r in cells.get((k, low, high), ()):
                if rank < before + r["n"]:
                    place[k, rank] = (r["first"], r["last"], before)
                    break
                before += r["n"]

    def between(k: int, at: float) -> float:
        low, high = place[k, math.floor(at)][0], place[k, math.ceil(at)][0]
        return low if low == high else (math.ceil(at) - at) * low + (at - math.floor(at)) * high

    return {k: (r["n"], [between(k, (r["n"] - 1) * q) for q in shares]) for k, r in series.items()}


#: The series of the chunks' least and greatest ratios; lengths have the numbers from 0.
LOW, HIGH = -1, -2


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", bands: Bands | None = None, sample: Fit | None = None) -> Bands:
    """bands narrowed to the rows that labels (id, label: 1 for good) call good.

    Every such row takes part; where ``Fit.rows`` is set, only so many labels,
    those of the smallest hashes. Ratios are taken of all of docs and then meet
    the labels, so no text is shuffled and no list of ids need be broadcast.
    """
    bands, sample, spark = bands or Bands(), sample or Fit(), docs.sparkSession
    text_batches(spark)
    tables = Tables(spark, "bands")
    good = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).alias("label")).where("label = 1").select("_id")
    if sample.rows is not None:
        good = good.orderBy(F.xxhash64("_id"), "_id").limit(sample.rows)
    # written first: else the join moves below the function, to the texts
    rows = tables.write(docs.select(F.col(id_col).alias("_id"), _ratios(bands)(text_col).alias("r")), "ratios").where("r IS NOT NULL").join(good, "_id", "left_semi").select("r.*")
    kind = F.floor(2 * F.log2("bytes")).cast("int")
    each = F.array(*[F.struct(k.alias("series"), F.col(c).alias("value")) for k, c in ((kind, "ratio"), (F.lit(LOW), "low"), (F.lit(HIGH), "high"))])
    found = quantiles(tables.write(rows.select(F.inline(each)).where("value IS NOT NULL"), "values"), (sample.share, 1 - sample.share))

    def narrowed(wide: tuple[float, float], low: int, high: int) -> tuple[float, float]:
        if low not in found or found[low][0] < sample.least:
            return wide
        return max(wide[0], found[low][1][0] - sample.margin), min(wide[1], found[high][1][1] + sample.margin)

    whole = []
    for k in range(2, 2 * math.ceil(math.log2(bands.whole[-2][0])) + 20 if len(bands.whole) > 1 else 60):
        whole.append((2 ** ((k + 1) / 2), *narrowed(limits(bands, 2 ** ((k + 0.5) / 2)), k, k)))
    return replace(bands, whole=(*whole, bands.whole[-1]), chunk=narrowed(bands.chunk, LOW, HIGH))
