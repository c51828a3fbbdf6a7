"""URL filters: a trie over reversed host labels and path segments, broadcast.

Each rule is a node: its host's labels from the top-level domain down, then its
path's segments, the last of which may be the beginning of a url's segment.
A url walks down once, passes every rule that fits it, and the longest wins.
Rules that end in one directory are found by the beginning of the url's segment,
of each length that such a rule has, so a step never costs more than a segment.
The list is counted first: up to ``MOST_RULES`` rules of together ``MOST_CHARS``
characters are broadcast as a trie; a longer list is joined instead, by
equality of the host's suffixes and of the path's beginnings with a rule's.

Defined results: a null url, or one without ``://``, has an empty host and path
and so fits no rule; a url that fits none has a null rule and the default
verdict; of rules as long as each other the one with the longer host wins; of a
rule given both ways the block wins; repeated rows give repeated results.
"""

from __future__ import annotations

import re
from bisect import insort
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netsieve.llm.shared import Tables

#: Bounds on a list that is broadcast.
MOST_RULES, MOST_CHARS = 500_000, 32_000_000

AUTHORITY = re.compile(r"://([^/?#]*)([^?#]*)", re.DOTALL)
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: A rule at its node: (order, rule, verdict); of several the greatest wins.
Rule = tuple[tuple, str, str]


@dataclass
class Node:
    below: dict[str, Node] = field(default_factory=dict)
    #: Of a host's node: the trie of its rules' paths.
    paths: Node | None = None
    #: Of a path's node: the rules that end in the beginning of a segment, by that beginning, and the beginnings' lengths.
    ends: dict[str, Rule] = field(default_factory=dict)
    lengths: list[int] = field(default_factory=list)


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path."""
    found = AUTHORITY.search(url or "")
    return (found[1].translate(LOWER), found[2]) if found else ("", "")


def build(rules: list[tuple[str, str, str]]) -> Node:
    """rules: (host, path, verdict)."""
    top = Node()
    for host, path, verdict in rules:
        node = top
        for label in reversed(host.split(".")):
            node = node.below.setdefault(label, Node())
        node.paths = node = node.paths or Node()
        *whole, last = path.split("/")
        for segment in whole:
            node = node.below.setdefault(segment, Node())
        rule = (len(host) + len(path), len(host), verdict == "block"), host + path, verdict
        node.ends[last] = max(node.ends.get(last, rule), rule)
        if len(last) not in node.lengths:
            insort(node.lengths, len(last))
    return top


def match(top: Node, host: str, path: str) -> tuple[str, str] | None:
    """The longest rule that fits, and its verdict."""
    best: Rule | None = None
    segments = path.split("/")
    node: Node | None = top
    for label in reversed(host.split(".")):
        if (node := node.below.get(label)) is None:
            break
        down = node.paths
        for segment in segments:
            if down is None:
                break
            for n in down.lengths:
                if n > len(segment):
                    break
                rule = down.ends.get(segment[:n])
                if rule and (best is None or rule > best):
                    best = rule
            down = down.below.get(segment)
    return best and best[1:]


def judged(url: Column | str, rules: list[tuple[str, str, str]], spark: SparkSession, default: str = "allow") -> Column:
    """struct<host, path, rule, verdict> of a url column, by a broadcast trie."""
    shared = spark.sparkContext.broadcast(sorted(set(rules)))
    tries: list[Node] = []

    @F.arrow_udf("host string, path string, rule string, verdict string")
    def url_verdict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if not tries:
            tries.append(build(shared.value))
        for urls in batches:
            hosts, paths, found, verdicts = [], [], [], []
            for url in urls:
                host, path = split_url(url.as_py())
                rule, verdict = match(tries[0], host, path) or (None, default)
                hosts.append(host)
                paths.append(path)
                found.append(rule)
                verdicts.append(verdict)
            yield pa.StructArray.from_arrays([pa.array(x, pa.string()) for x in (hosts, paths, found, verdicts)], ["host", "path", "rule", "verdict"])

    return url_verdict(F.col(url) if isinstance(url, str) else url)


def joined(pages: DataFrame, rules: DataFrame, id_col: str, url_col: str, default: str) -> DataFrame:
    """The same verdicts for a list of any length, without a broadcast.

    Each different place (host, path) has as many suffixes as its host has
    labels. One that rules have is paired with the lengths of these rules'
    paths, and the path's beginning of each such length meets the rules by
    equality: a place never meets rules that do not fit it. Places and pairs
    come from written tables, so that Spark splits a host of very many places.
    """
    tables = Tables(pages.sparkSession, "urls")
    order = F.struct(F.length(F.concat("r_host", "r_path")).alias("n"), F.length("r_host").alias("h"), (F.col("r_verdict") == "block").alias("b"), F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict"))
    after = F.regexp_extract(url_col, r"(?s)://([^/?#]*)([^?#]*)", 0)
    host = F.translate(F.regexp_extract(url_col, r"(?s)://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(url_col, r"(?s)://[^/?#]*([^?#]*)", 1)
    split = pages.select(F.col(id_col), F.when(after != "", host).otherwise("").alias("host"), F.when(after != "", path).otherwise("").alias("path"))
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    known = rules.select(F.col("host").alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict"))
    known = tables.write(known.groupBy("r_host", "r_path").agg(F.min_by("r_verdict", F.col("r_verdict") != "block").alias("r_verdict")), "rules")
    lengths = tables.write(known.groupBy("r_host").agg(F.collect_set(F.length("r_path")).alias("lengths")), "lengths")
    places = tables.write(split.select("host", "path").distinct().withColumn("r_host", F.explode(suffixes)), "places")
    fitting = F.filter("lengths", lambda n: n <= F.length("path"))
    met = tables.write(places.join(lengths, "r_host").withColumn("n", F.explode(fitting)).withColumn("r_path", F.substr("path", F.lit(1), F.col("n"))).drop("lengths", "n"), "met")
    best = tables.write(met.join(known, ["r_host", "r_path"]).groupBy("host", "path").agg(F.max(order).alias("best")), "best")
    return split.join(best, ["host", "path"], "left").select(id_col, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", most_rules: int = MOST_RULES) -> DataFrame:
    """(id, host, path, rule, verdict) for every row; rules: host, path, verdict (allow or block)."""
    rules = rules.select("host", "path", "verdict").dropna()
    count, chars = rules.agg(F.count("*"), F.coalesce(F.sum(F.length("host") + F.length("path")), F.lit(0))).first()
    if count > most_rules or chars > MOST_CHARS:
        return joined(pages, rules, id_col, url_col, default)
    listed = [tuple(row) for row in rules.collect()]  # counted just before
    url = judged(url_col, listed, pages.sparkSession, default)
    return pages.select(F.col(id_col), url.alias("_url")).select(id_col, "_url.*")
