"""Labels for sessions from flow logs and attack schedules, and their audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Class triples of flow-log and schedule labels.
FLOW_LABELS = {
    "BENIGN": "Benign/Benign/Benign", "FTP-Patator": "Malware/Patator/FTP-Patator", "SSH-Patator": "Malware/Patator/SSH-Patator", "DoS Hulk": "Malware/DoS/Hulk",
    "DoS GoldenEye": "Malware/DoS/GoldenEye", "DoS slowloris": "Malware/DoS/Slowloris", "DoS Slowhttptest": "Malware/DoS/Slowhttptest", "Heartbleed": "Malware/Heartbleed/Heartbleed",
    "Web Attack - Brute Force": "Malware/Web-Attack/Brute-Force", "Web Attack - XSS": "Malware/Web-Attack/XSS", "Web Attack - Sql Injection": "Malware/Web-Attack/Sql-Injection",
    "Infiltration": "Malware/Infiltration/Infiltration", "Bot": "Malware/Bot/Bot", "PortScan": "Malware/PortScan/PortScan", "DDoS": "Malware/DDoS/LOIC",
}
SCHEDULE_LABELS = {
    "Benign": "Benign/Benign/Benign", "FTP-BruteForce": "Malware/Patator/FTP-Patator", "SSH-BruteForce": "Malware/Patator/SSH-Patator", "DoS-GoldenEye": "Malware/DoS/GoldenEye",
    "DoS-Slowloris": "Malware/DoS/Slowloris", "DoS-Hulk": "Malware/DoS/Hulk", "DoS-SlowHTTPTest": "Malware/DoS/Slowhttptest", "DDoS-LOIC-HTTP": "Malware/DDoS/LOIC-HTTP",
    "DDoS-LOIC-UDP": "Malware/DDoS/LOIC-UDP", "DDoS-HOIC": "Malware/DDoS/HOIC", "BruteForce-Web": "Malware/Web-Attack/Brute-Force", "BruteForce-XSS": "Malware/Web-Attack/XSS",
    "SQL-Injection": "Malware/Web-Attack/Sql-Injection", "Infiltration": "Malware/Infiltration/Infiltration", "Bot": "Malware/Bot/Bot",
}
CLOCKS = ("dd/MM/yyyy hh:mm:ss", "dd/MM/yyyy HH:mm:ss", "d/M/yyyy H:mm:ss", "d/M/yyyy H:mm")


def triple(label: Column, known: dict[str, str]) -> Column:
    """task1/task2/task3 of a label; an unknown one is Malware, its blanks made '-'."""
    plain = F.regexp_replace(F.trim(label), r"\s+", "-")
    found = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    return F.coalesce(F.get(F.array(found[F.trim(label)]), F.lit(0)), F.concat_ws("/", F.lit("Malware"), plain, plain))


def clock(text: Column, hours_west: int) -> Column:
    """A local time in any of the known forms, as a time in UTC."""
    local = F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in CLOCKS])
    return local + F.expr(f"INTERVAL {hours_west} HOURS")


def ends_key(src: Column, sport: Column, dst: Column, dport: Column, l4: Column) -> Column:
    """One key for a 5-tuple in either direction."""
    a, b = F.concat_ws(":", src, sport), F.concat_ws(":", dst, dport)
    return F.concat_ws("|", F.least(a, b), F.greatest(a, b), l4)


def interval_labels(sessions: DataFrame, flows: DataFrame, key: list[str], session_id: str, first: str, last: str, time: str, label: str, benign: str, tolerance: float = 0.0, twin: float | None = None) -> DataFrame:
    """(session_id, label, how) of each session by the flows of its key.

    Flows within [first - tolerance, last + tolerance] (or ``twin`` later, for a
    clock without AM and PM) decide; two different labels there are 'double',
    and of one label the most frequent that isn't benign counts. With no flow
    inside, the nearest one's label holds; with none of the key, 'unlabeled'. A
    session without a first or last time is 'damaged', whatever its flows.

    The join is an equality on the key, whose matches are reduced to one row a
    session by partial aggregates: label sets and a nearest minimum, no lists.
    """
    times = flows.select(*key, F.col(time).alias("t"), F.col(label).alias("label"))
    if twin is not None:
        times = times.select(*key, F.explode(F.array("t", F.col("t") + F.lit(twin))).alias("t"), "label")
    met = sessions.select(session_id, *key, F.col(first).alias("t0"), F.col(last).alias("t1")).join(times, key, "left")
    inside = F.col("t").between(F.col("t0") - tolerance, F.col("t1") + tolerance)
    away = F.greatest(F.col("t0") - F.col("t"), F.col("t") - F.col("t1"), F.lit(0.0))
    within = F.when(inside, F.col("label"))
    found = met.groupBy(session_id).agg(
        F.countDistinct(within).alias("n"),
        F.coalesce(F.max(F.when(within != benign, within)), F.max(within)).alias("only"),
        F.min_by("label", F.struct(away.alias("d"), F.col("t"), F.col("label"))).alias("nearest"),
        F.count("t").alias("flows"),
        F.bool_or(F.col("t0").isNull() | F.col("t1").isNull()).alias("damaged"),
    )
    how = F.when(F.col("damaged"), "damaged").when(F.col("flows") == 0, "unlabeled").when(F.col("n") > 1, "double").when(F.col("n") == 1, "inside").otherwise("nearest")
    chosen = F.when(how == "inside", F.col("only")).when(how == "nearest", F.col("nearest")).otherwise(how)
    return found.select(session_id, chosen.alias("label"), how.alias("how"))


def schedule_labels(sessions: DataFrame, schedule: DataFrame, session_id: str, time: str, a: str, b: str, benign: str = "Benign", tolerance: float = 0.0) -> DataFrame:
    """(session_id, label): the window that holds the session's time and both of its ends, in either direction.

    schedule: start, end, attackers, victims (arrays), attack. Windows become
    one row for each unordered pair of ends, so the join is an equality with a
    range check; two windows or more are 'double', none is benign. Bounds are inclusive.
    """
    pairs = schedule.select("start", "end", "attack", F.explode("attackers").alias("x"), "victims").select("start", "end", "attack", "x", F.explode("victims").alias("y"))
    pairs = pairs.select("start", "end", "attack", F.least("x", "y").alias("low"), F.greatest("x", "y").alias("high")).distinct()
    s = sessions.select(F.col(session_id), F.col(time).alias("t"), F.least(a, b).alias("low"), F.greatest(a, b).alias("high"))
    hit = s.join(pairs, ["low", "high"], "left")
    inside = F.col("t").between(F.col("start") - tolerance, F.col("end") + tolerance)
    n = F.count_if(inside)
    label = F.when(n > 1, "double").when(n == 1, F.max(F.when(inside, F.col("attack")))).otherwise(benign)
    return hit.groupBy(session_id).agg(label.alias("label"))


def audit(rows: DataFrame, key: list[str], label: str, benign: str) -> DataFrame:
    """(labels, keys, kind): how many keys carry which set of labels; kind is single, multi or benign+attack."""
    sets = rows.groupBy(*key).agg(F.array_sort(F.collect_set(label)).alias("labels"))
    kind = F.when(F.size("labels") <= 1, "single").when(F.array_contains("labels", benign), "benign+attack").otherwise("multi")
    return sets.groupBy(F.array_join("labels", "+").alias("labels"), kind.alias("kind")).agg(F.count("*").alias("keys"))


def count_check(found: DataFrame, expected: DataFrame, name: str, n: str) -> DataFrame:
    """(name, found, expected, ok) over the classes of either side."""
    left = found.select(name, F.col(n).alias("found"))
    right = expected.select(name, F.col(n).alias("expected"))
    both = left.join(right, name, "full")
    return both.select(name, F.coalesce("found", F.lit(0)).alias("found"), F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce(F.col("found") == F.col("expected"), F.lit(False)).alias("ok"))


def dominant_suffix(rows: DataFrame, group: list[str], host: str, domain: str, most: int = 20, order: str | None = None) -> DataFrame:
    """(group, domain, host, verdict): the most frequent host of up to ``most`` samples of each group against its domain."""
    from pyspark.sql.window import Window

    rank = F.row_number().over(Window.partitionBy(*group).orderBy(order or host))
    some = rows.withColumn("_k", rank).where(F.col("_k") <= most)
    counts = some.where(F.col(host) != "").groupBy(*group, domain, host).agg(F.count("*").alias("n"))
    top = counts.groupBy(*group, domain).agg(F.min_by(host, F.struct((-F.col("n")).alias("n"), F.col(host).alias("h"))).alias("host"))
    every = some.select(*group, domain).distinct().join(top, [*group, domain], "left")
    right = (F.col("host") == F.col(domain)) | F.col("host").endswith(F.concat(F.lit("."), F.col(domain)))
    verdict = F.when(F.col("host").isNull(), "NO_SNI").when(right, "OK").otherwise("MISMATCH")
    return every.select(*group, domain, "host", verdict.alias("verdict"))
