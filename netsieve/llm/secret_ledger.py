"""Secret scans with an incremental blob ledger, in DataFrame operations only.

Every version of a text is a blob named by its SHA-256 digest. Three tables
only grow: ``paths`` holds which path had which blob, ``ledger`` the pairs
(blob, rule version) that were scanned, and ``findings`` their spans. A scan
enters the versions' paths, leaves out the pairs in the ledger, scans one copy
of each blob that remains, appends to both tables, and joins the findings back
to every path that holds the blob, in this call or in any before.

Spans come from two native calls for each rule: the matches of a pattern and
the text between them, whose lengths add up to places in code points. Sums over
the matches of one text are made in blocks of blocks, so that a text of very
many matches costs in proportion to them.

A part of a table is a folder named by the scan that wrote it (the blobs of a
scan under way are in ``pending``); findings are written before their blobs are
entered, so a scan that died leaves blobs unscanned but never findings lost: a
later scan repeats them and readers take each finding once.

Defined results: a null text counts as empty; empty texts and texts without
findings return rows with counts 0 and no spans; repeated rows give repeated
results; null paths are kept; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netsieve.llm.shared import Tables, broadcast_if_small


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of a pattern; those whose ``group`` has under ``least`` characters are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    #: A substring, or a pattern with ``rlike``, without which there can be no match.
    needs: str | None = None


#: The patterns of the base kinds, and two more kinds.
RULES = (
    Rule("assign", r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", group=1, least=12),
    Rule("access", r"AKIA[A-Z0-9]+", least=18, needs="AKIA"),
    Rule("hex", r"[0-9a-f]{16,}", least=16),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", needs="-----BEGIN "),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}", needs="gh"),
)
BASE = ("assign", "access", "hex")

#: Bytes of findings that are broadcast to the rows, and about those of one span.
MOST_BYTES, SPAN_BYTES = 32 << 20, 48

#: Elements that are summed one after the other, and characters of a piece that a long text is cut into.
BLOCK, PIECE = 64, 4096

SPAN = "array<struct<start: int, order: int, end: int, kind: string>>"
BLOB = "blob string, rules string"


def rule_version(rules: tuple[Rule, ...]) -> str:
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _fold(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """The results so far at each element, by a plain loop (which copies them at each step)."""
    start = F.struct(F.lit(0).alias("now"), F.array().cast("array<int>").alias("all"))

    def step(acc: Column, x: Column) -> Column:
        return let(join(acc["now"], x), lambda now: F.struct(now.alias("now"), F.array_append(acc["all"], now).alias("all")))

    return F.aggregate(values, start, step, lambda acc: acc["all"])


def running(values: Column, join: Callable[[Column, Column], Column], levels: int = 2) -> Column:
    """The results so far of ``join`` (a sum or a maximum, from 0) at each element of array<int>, in blocks of blocks."""
    if levels == 0:
        return _fold(values, join)

    def blocks(all_values: Column) -> Column:
        starts = F.when(F.size(all_values) > 0, F.sequence(F.lit(0), F.size(all_values) - 1, F.lit(BLOCK))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda at: _fold(F.slice(all_values, at + 1, F.lit(BLOCK)), join))

    def placed(inner: Column) -> Column:
        lasts = F.transform(inner, lambda block: F.get(block, F.size(block) - 1))
        return let(running(lasts, join, levels - 1), lambda totals: F.flatten(F.transform(inner, lambda block, k: let(F.coalesce(F.get(totals, k - 1), F.lit(0)), lambda before: F.transform(block, lambda x: join(before, x))))))

    return let(let(values, blocks), placed)


def _add(a: Column, b: Column) -> Column:
    return a + b


def _greater(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def spans_of(text: Column, rule: Rule, order: int) -> Column:
    """Start, end (code points, end exclusive) and kind of a rule's matches in a text."""
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    between = F.transform(F.split(text, rule.pattern, -1), F.length)

    def placed(match: Column) -> Column:
        lengths = F.transform(match, F.length)
        # there is one text between more than there are matches
        steps = let(between, lambda gaps: F.transform(lengths, lambda n, k: F.get(gaps, k) + n))

        def spans(end: Column) -> Column:
            each = F.transform(match, lambda m, k: F.struct((F.get(end, k) - F.length(m)).alias("start"), F.lit(order).alias("order"), F.get(end, k).alias("end"), F.lit(rule.kind).alias("kind")))
            if not rule.group:
                return F.filter(each, lambda s: s["end"] - s["start"] >= rule.least)
            fits = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), lambda g: F.length(g) >= rule.least)
            return let(fits, lambda fit: F.filter(each, lambda s, k: F.get(fit, k)))

        return let(running(steps, _add), spans)

    may = F.contains(text, F.lit(rule.needs)) if rule.needs else F.lit(True)
    return F.when(may & F.regexp_like(text, pattern), let(found, placed)).otherwise(F.array().cast(SPAN))


def scan(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, spans) of the blobs (blob, text) that have any, spans by start, then in the order of the rules."""
    spans = F.sort_array(F.concat(*[spans_of(F.col("text"), rule, k) for k, rule in enumerate(rules)]))
    return blobs.select("blob", spans.alias("spans")).where(F.size("spans") > 0)


class Ledger:
    """Ledger and findings under one folder that all executors reach."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{self.folder}/{name}")

    def scanned(self) -> DataFrame:
        return self._read("ledger", BLOB)

    def findings(self) -> DataFrame:
        return self._read("findings", f"{BLOB}, spans {SPAN}").dropDuplicates(["blob", "rules"])

    def recorded(self, names: str) -> DataFrame:
        """(names, blob) of every version that was ever entered; names: the DDL of the path's column."""
        return self._read("paths", f"{names}, blob string")

    def update(self, versions: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
        """Enter versions and scan their blobs that these rules have not seen.

        Returns the versions' (id, blob), one row each, and the blobs scanned now (blob, rules).
        """
        version, part = rule_version(rules), uuid.uuid4().hex
        text = F.coalesce(F.col(text_col), F.lit(""))
        named = versions.select(F.col(id_col), blob_of(text).alias("blob"))
        named.write.parquet(f"{self.folder}/paths/{part}")
        named = self.spark.read.schema(named.schema).parquet(f"{self.folder}/paths/{part}")
        seen = self.scanned().where(F.col("rules") == version).select("blob")
        first = seen.isEmpty()
        new = named.select("blob").distinct()
        new = new if first else new.join(seen, "blob", "left_anti")
        new.select("blob", F.lit(version).alias("rules")).write.parquet(f"{self.folder}/pending/{part}")
        new = self.spark.read.schema(BLOB).parquet(f"{self.folder}/pending/{part}")
        copies = versions.select(blob_of(text).alias("blob"), text.alias("text"))
        # copies meet in the map-side part of the aggregate, so a blob of very many copies is no hot group
        unseen = copies if first else copies.join(new.select("blob"), "blob", "left_semi")
        found = scan(unseen.groupBy("blob").agg(F.first("text").alias("text")), rules)
        found.select("blob", F.lit(version).alias("rules"), "spans").write.parquet(f"{self.folder}/findings/{part}")
        new.write.parquet(f"{self.folder}/ledger/{part}")
        return named, new

    def join(self, rows: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
        """Rows that have a blob column, with the spans found in it, null where there are none.

        Findings are measured first; up to MOST_BYTES are broadcast, more meet the rows by shuffle.
        """
        found = self.findings().where(F.col("rules") == rule_version(rules)).select("blob", "spans")
        return rows.join(broadcast_if_small(found, F.size("spans") * SPAN_BYTES + 64, MOST_BYTES), "blob", "left")

    def paths(self, named: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """(id, blob, spans) for every row of (id, blob), spans being empty where nothing was found."""
        return self.join(named, rules).select(*named.columns, F.coalesce("spans", F.array().cast(SPAN)).alias("spans"))

    def history(self, names: str = "doc_id long", rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """paths() of every different (path, blob) that was ever entered: findings reach all paths that hold or held them."""
        return self.paths(self.recorded(names).distinct(), rules)


def scan_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, folder: str | None = None) -> DataFrame:
    """(id, blob, spans) after an update of the ledger in a folder, or of a new ledger in the shared one."""
    ledger = Ledger(docs.sparkSession, folder or Tables(docs.sparkSession, "secrets").path)
    named, _ = ledger.update(docs, id_col, text_col, rules)
    return ledger.paths(named, rules)


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def report(findings: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and digests of what ``scan_documents`` returns."""
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return findings.select(id_col, *map(count, BASE), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def replaced(text: Column, spans: Column, mark: str) -> Column:
    """A text with a mark for each run of overlapping spans, in proportion to its length and the spans.

    The text is cut into pieces of PIECE characters, so that no part of it is
    looked for from its beginning; spans are sorted by start.
    """

    def clean(pieces: Column, spans: Column, ends: Column) -> Column:
        """ends: the greatest end up to each span."""

        def part(start: Column, end: Column) -> Column:
            first, last = F.floor(start / PIECE).cast("int"), F.floor(end / PIECE).cast("int")
            one = F.substr(F.get(pieces, first), start - first * PIECE + 1, end - start)
            ahead = F.substr(F.get(pieces, first), start - first * PIECE + 1)
            whole = F.array_join(F.slice(pieces, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
            more = F.concat(ahead, whole, F.coalesce(F.substr(F.get(pieces, last), F.lit(1), end - last * PIECE), F.lit("")))
            return F.when(start >= end, "").when(first == last, one).otherwise(more)

        def before(span: Column, k: Column) -> Column:
            at = F.coalesce(F.get(ends, k - 1), F.lit(0))
            return F.when(span["start"] < at, "").otherwise(F.concat(part(at, span["start"]), F.lit(mark)))

        tail = part(F.get(ends, F.size(ends) - 1), F.length(text))
        return F.concat(F.array_join(F.transform(spans, before), ""), tail)

    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    return let(pieces, lambda p: let(spans, lambda s: let(running(F.transform(s, lambda x: x["end"]), _greater), lambda e: clean(p, s, e))))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, mark: str = "[SECRET]", folder: str | None = None, length_col: str | None = None) -> DataFrame:
    """The documents with the text of every span replaced; overlapping spans are replaced as one.

    Rows and columns stay as they are but for the text. Texts without findings
    are not rewritten, a null text stays null. length_col, if given, is set to
    the characters of each rewritten text.
    """
    spark = docs.sparkSession
    ledger = Ledger(spark, folder or Tables(spark, "secrets").path)
    ledger.update(docs, id_col, text_col, rules)
    rows = ledger.join(docs.select(F.struct(*docs.columns).alias("_row"), blob_of(F.col(text_col)).alias("blob")), rules)
    text = F.col("_row")[text_col]
    out = rows.withColumn("_text", F.when(F.col("spans").isNull() | text.isNull(), text).otherwise(replaced(text, F.col("spans"), mark)))
    length = {length_col: F.when(F.col("spans").isNull(), F.col("_row")[length_col]).otherwise(F.length("_text").cast("long"))} if length_col else {}
    columns = {text_col: F.col("_text")} | length
    return out.select(*[columns.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])
