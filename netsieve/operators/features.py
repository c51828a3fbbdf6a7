"""Flow features: statistics over packet arrays, rates, vectors, flags and header bytes.

A flow's packets are gathered once, in order, as an array of structs; every
feature is then a projection of arrays, so hundreds of features cost one
shuffle. Missing values are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from netsieve.functions.exprs import ratio

STATISTICS = ("sum", "max", "min", "mean", "var", "std", "sstd", "gmean", "q25", "q50", "q75", "iqr", "range", "skew", "kurt")
PREFIXES = (None, 5, 10, 15, 20, 25, 30)
FLAGS = ("S", "SA", "A", "FA", "F", "R", "PA", "FPA", "RA")
EPSILON = 1e-9


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _quantile(ordered: Column, q: float) -> Column:
    """Linear interpolation between the neighbours."""
    at = (F.size(ordered) - 1) * F.lit(q)
    low, high = F.floor(at).cast("int"), F.ceil(at).cast("int")
    a, b = F.get(ordered, low), F.get(ordered, high)
    return a + (b - a) * (at - low)


def statistics(values: Column) -> dict[str, Column]:
    """The 15 statistics of an array of doubles; all null if it is empty or a single 0."""
    n = F.size(values).cast("double")
    there = (F.size(values) > 0) & ~((F.size(values) == 1) & (F.get(values, F.lit(0)) == 0))
    ordered = F.array_sort(values)
    total = _sum(values)
    mean = total / n
    m2, m3, m4 = (_moment(values, mean, n, p) for p in (2, 3, 4))
    positive = F.forall(values, lambda x: x > 0)
    q25, q50, q75 = (_quantile(ordered, q) for q in (0.25, 0.5, 0.75))
    top, bottom = F.array_max(values), F.array_min(values)
    spread = m2 > 0
    found = {
        "sum": total,
        "max": top,
        "min": bottom,
        "mean": mean,
        "var": m2,
        "std": F.sqrt(m2),
        "sstd": F.when(n > 1, F.sqrt(m2 * n / (n - 1))).otherwise(0.0),
        "gmean": F.when(positive, F.exp(_sum(F.transform(values, lambda x: F.ln(x))) / n)),
        "q25": q25,
        "q50": q50,
        "q75": q75,
        "iqr": q75 - q25,
        "range": top - bottom,
        "skew": F.when(spread, m3 / F.pow(m2, F.lit(1.5))),
        "kurt": F.when(spread, m4 / (m2 * m2) - 3),
    }
    return {name: F.when(there, column) for name, column in found.items()}


def _moment(values: Column, mean: Column, n: Column, p: int) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + F.pow(x - mean, F.lit(float(p)))) / n


def directional(values: Column) -> dict[str, Column]:
    """Both, Forward (positive) and Backward (negative, as magnitudes); zeros are in Both alone."""
    return {
        "Both": F.transform(values, lambda x: F.abs(x)),
        "Forward": F.filter(values, lambda x: x > 0),
        "Backward": F.transform(F.filter(values, lambda x: x < 0), lambda x: -x),
    }


def prefix(values: Column, k: int | None) -> Column:
    return values if k is None else F.slice(values, 1, k)


def scalar_block(name: str, values: Column) -> dict[str, Column]:
    """All statistics of a signed array by direction and prefix: {name}_{direction}_{prefix}_{statistic}."""
    found = {}
    for way, part in directional(values).items():
        for k in PREFIXES:
            for statistic, column in statistics(prefix(part, k)).items():
                found[f"{name}_{way}_{k or 'All'}_{statistic}"] = column
    return found


def flows(packets: DataFrame, key: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """One row a flow: its packets as an ordered array of structs of the columns."""
    struct = F.struct(*order, *[c for c in columns if c not in order])
    return packets.groupBy(*key).agg(F.array_sort(F.collect_list(struct)).alias("packets"))


def arrivals(packets: DataFrame, key: list[str], order: list[str], time: str, forward: Column) -> DataFrame:
    """packets with ``iat``: seconds since the flow's packet before, negative for backward ones; null for the first."""
    before = F.lag(time).over(Window.partitionBy(*key).orderBy(*order))
    gap = F.col(time) - before
    return packets.withColumn("iat", F.when(forward, gap).otherwise(-gap))


def direction_index(packets: DataFrame, key: list[str], order: list[str], forward: Column) -> DataFrame:
    """packets with ``dir_index``: 1, 2, ... of forward and -1, -2, ... of backward packets."""
    n = F.row_number().over(Window.partitionBy(*key, forward).orderBy(*order))
    return packets.withColumn("dir_index", F.when(forward, n).otherwise(-n))


def rates(packets: Column, size: str, time: str, way: str) -> dict[str, Column]:
    """Bytes and packets a second, duration, count and mean gap of both directions and each; way is a field, 1 forward, -1 backward."""
    found = {}
    for name, sign in (("Both", 0), ("Forward", 1), ("Backward", -1)):
        part = _of(packets, way, sign) if sign else packets
        n, times = F.size(part), F.transform(part, lambda p: p[time])
        total = F.aggregate(part, F.lit(0.0), lambda a, p: a + p[size])
        duration = F.when(n >= 2, F.array_max(times) - F.array_min(times))
        found |= {
            f"Bps_{name}": ratio(total, duration),
            f"Pps_{name}": ratio(n, duration),
            f"Duration_{name}": duration,
            f"Packet_Count_{name}": n,
            f"Mean_Arrived_{name}": ratio(duration, n - 1),
        }
    return found


def _of(packets: Column, way: str, sign: int) -> Column:
    return F.filter(packets, lambda p: p[way] == F.lit(sign))


def padded(values: Column, n: int) -> Column:
    """The first n magnitudes, zeros behind."""
    some = F.slice(F.transform(values, lambda x: F.abs(x)), 1, n)
    return F.concat(some, F.array_repeat(F.lit(0.0), F.lit(n) - F.size(some)))


def flag_counts(flags: Column) -> dict[str, Column]:
    """How many packets carry exactly each of the flag texts."""
    return {f"flag_{name}": _count(flags, name) for name in FLAGS}


def _count(flags: Column, name: str) -> Column:
    return F.size(F.filter(flags, lambda x: x == F.lit(name)))


def high_low(value: Column) -> tuple[Column, Column]:
    """The two bytes of a 16-bit value; -1 stays -1 in both."""
    return F.when(value < 0, -1).otherwise(F.shiftright(value, 8).bitwiseAND(255)), F.when(value < 0, -1).otherwise(value.bitwiseAND(255))


def derived(pkt: Column, size: Column, fwd: Column, fwd_b: Column, bwd: Column, bwd_b: Column, first: Column, last: Column) -> dict[str, Column]:
    """Duration, rates and ratios of a session's counts."""
    duration = F.greatest(last - first, F.lit(0.0))
    return {
        "duration": duration,
        "pkt_rate": pkt / (duration + EPSILON),
        "byte_rate": size / (duration + EPSILON),
        "mean_pkt_size": size / (pkt + EPSILON),
        "fwd_pkt_ratio": fwd / (pkt + EPSILON),
        "fwd_byte_ratio": fwd_b / (size + EPSILON),
        "fwd_bwd_pkt_ratio": fwd / (bwd + 1.0),
        "fwd_bwd_byte_ratio": fwd_b / (bwd_b + 1.0),
    }


#: Parts of a feature name that tell its category.
CATEGORIES = {"header": ("ip_", "tcp_", "udp_"), "flag": ("flag_",), "size": ("packet_sizes_", "PSD_"), "iat": ("iat_", "IAT_"), "payload": ("payload_",), "rate": ("Bps_", "Pps_", "Duration_", "Packet_Count_", "Mean_Arrived_", "Ratio_")}


def category(feature: str) -> str:
    return next((name for name, starts in CATEGORIES.items() if feature.startswith(starts)), "other")


def feature_set(features: list[str], name: str) -> list[str]:
    """all, only_<category>, no_<category>, or categories joined by '+'."""
    if name == "all":
        return features
    if name.startswith("only_"):
        return [f for f in features if category(f) == name[5:]]
    if name == "no_headerflags":
        return [f for f in features if category(f) not in ("header", "flag")]
    if name.startswith("no_"):
        return [f for f in features if category(f) != name[3:]]
    return [f for f in features if category(f) in name.split("+")]
