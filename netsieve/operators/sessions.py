"""Packet rows to session rows: one partial aggregate for each stream.

A stream's two ends are named by their order as text, so counts by direction
need no earlier pass: both directions are summed apart and the client's picked
once it is known. First-of values are minima by frame; only the capped ordered
folds need rows in order, and those first reduce each different value to its
first frame and keep no more values than the cap can hold.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from netsieve.functions.exprs import layers, task_part
from netsieve.schemas import FIELDS, SESSION_COLUMNS, with_defaults

KEYS = ["filename", "proto", "stream"]

# Info texts that are kept, marks of suspicious addresses, and by port the (mode, payload in hex) of service probes as the public scanner tools send them.
KEPT_INFO = (
    "tcp dup ack", "previous segment not captured", "packet size limited during capture", "malformed", "truncated", "retransmission", "zerowindow",
    "zero window", "out-of-order", "out of order", "acked unseen segment", "spurious", "reassembly error",
)
SUSPICIOUS = (
    "/vulnerabilities/xss", "/vulnerabilities/sqli", "/vulnerabilities/brute", "/vulnerabilities/exec", "/vulnerabilities/fi", "/vulnerabilities/upload",
    "<script", "</script", "alert(", "onerror=", "onmouseover=", "javascript:", "union select", "union all select", "' or ", "or 1=1", "1=1--", "1=1#", "/etc/passwd", "../../",
)
PROBES = {
    "53": (("contains", "76657273696f6e0462696e64"), ("prefix", "000010000000000000000000")),
    "5353": (("contains", "76657273696f6e0462696e64"), ("prefix", "000010"), ("prefix", "0000000000010000")),
    "111": (("prefix", "72fe1d13"), ("prefix", "3eece3ca")),
    "137": (("prefix", "80f00010"), ("prefix", "01910000"), ("prefix", "01910010"), ("contains", "434b414141")),
    "161": (("prefix", "303a020103"), ("prefix", "301f0201000406"), ("contains", "7075626c6963")),
    "1900": (("prefix", "4d2d534541524348"),),
    "177": (("prefix", "00010002000100"),),
    "623": (("prefix", "0600ff06"), ("prefix", "0600ff07")),
    "123": (("prefix", "e30004fa"), ("prefix", "d9000afa")),
    "47808": (("prefix", "810a"),),
    "5060": (("prefix", "4f5054494f4e53207369703a"),),
}
HEARTBEAT, HELLO = "24", {"has_TLS_CHLO": "1", "has_TLS_SHLO": "2"}
INFO_CAP, ARGUMENT_CAP, ITEM_CAP = 1000, 512, 64


def _any_true(text: Column) -> Column:
    return F.exists(F.split(text, ","), lambda v: F.lower(F.trim(v)).isin("1", "true"))


def _full(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def typed(packets: DataFrame) -> DataFrame:
    """Text fields as values: stream, order, time, ends, payload and flags. Rows without a stream are dropped."""
    p = with_defaults(packets, ["filename", "class_name", *FIELDS], "")
    col = {name: p[f"`{name}`"] for name in FIELDS}
    proto = F.when(col["tcp.stream"] != "", "tcp").when(col["udp.stream"] != "", "udp")
    length = F.coalesce(F.split_part(col["tcp.len"], F.lit(","), F.lit(1)).try_cast("long"), F.greatest(F.split_part(col["udp.length"], F.lit(","), F.lit(1)).try_cast("long") - 8, F.lit(0)), F.lit(0))

    def address(way: str) -> Column:
        return F.coalesce(_full(col[f"ip.{way}"]), _full(col[f"ipv6.{way}"]), F.lit("-"))

    def port(way: str) -> Column:
        return F.coalesce(_full(col[f"tcp.{way}port"]), _full(col[f"udp.{way}port"]), F.lit("-"))

    out = p.select(
        "filename",
        "class_name",
        proto.alias("proto"),
        F.coalesce(_full(col["tcp.stream"]), _full(col["udp.stream"])).alias("stream"),
        col["frame.number"].try_cast("long").alias("frame"),
        col["frame.time_epoch"].try_cast("decimal(20,6)").alias("ts"),
        F.struct(address("src").alias("ip"), port("src").alias("port")).alias("source"),
        F.struct(address("dst").alias("ip"), port("dst").alias("port")).alias("target"),
        F.greatest(length, F.lit(0)).alias("length"),
        *[_any_true(col[f"tcp.flags.{f}"]).alias(f) for f in ("syn", "ack", "fin", "reset")],
        *[col[name].alias(name.replace(".", "_")) for name in FIELDS if name not in ("frame.number", "frame.time_epoch")],
    )
    return out.where("proto IS NOT NULL")


def first_of(value: Column, when: Column | None = None, order: str = "frame") -> Column:
    """An aggregate: the value of the first packet that has one, '-' if none has."""
    there = (F.coalesce(value, F.lit("")) != "") if when is None else when
    return F.coalesce(F.min_by(F.when(there, value), F.when(there, F.col(order))), F.lit("-"))


def capped_folds(rows: DataFrame, keys: list[str], order: str, folds: dict[str, tuple[Column, int, int | None, int]]) -> DataFrame:
    """One row a key with each fold: the different values in order of appearance, joined by ' || ', null where there are none.

    folds: name -> (value, cap, item, least). Values are added while the
    characters so far are under ``cap``, so the last may exceed it; ``item`` cuts
    each value. As every value has ``least`` characters, only cap / least + 1 of
    them can be taken, which bounds a group. All folds are made in one pass.
    """
    taken = [F.struct(F.lit(name).alias("kind"), (F.substring(value, 1, item) if item else value).alias("v")) for name, (value, _, item, _) in folds.items()]
    each = F.filter(F.array(*taken), lambda x: F.coalesce(x["v"], F.lit("")) != "")
    firsts = rows.select(*keys, F.col(order).alias("o"), F.explode(each).alias("x")).groupBy(*keys, "x").agg(F.min("o").alias("o"))
    rank = F.row_number().over(Window.partitionBy(*keys, "x.kind").orderBy("o", "x.v"))
    most = max(cap // least + 1 for _, cap, _, least in folds.values())
    few = firsts.withColumn("k", rank).where(F.col("k") <= most)
    listed = few.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("k", F.col("x.kind").alias("kind"), F.col("x.v").alias("v")))).alias("all"))

    def fold(name: str, cap: int) -> Column:
        start = F.struct(F.lit(0).alias("n"), F.array().cast("array<string>").alias("kept"))

        def add(acc: Column, x: Column) -> Column:
            more = F.struct((acc["n"] + F.length(x["v"])).alias("n"), F.array_append(acc["kept"], x["v"]).alias("kept"))
            return F.when(acc["n"] < cap, more).otherwise(acc)

        kept = F.aggregate(F.filter("all", lambda x: x["kind"] == name), start, add, lambda acc: acc["kept"])
        return F.when(F.size(kept) > 0, F.array_join(kept, " || ")).alias(name)

    return listed.select(*keys, *[fold(name, cap) for name, (_, cap, _, _) in folds.items()])


def capped_distinct(rows: DataFrame, keys: list[str], order: str, value: str, cap: int, item: int | None = None, least: int = 1) -> DataFrame:
    """capped_folds of one column, under its own name."""
    return capped_folds(rows, keys, order, {value: (F.col(value), cap, item, least)})


def _is_probe() -> Column:
    payload, port = F.lower(F.replace(F.col("udp_payload"), F.lit(":"))), F.col("target.port")
    tests = [port.isin(number) & reduce(or_, (payload.startswith(mark) if mode == "prefix" else payload.contains(mark) for mode, mark in marks)) for number, marks in PROBES.items()]
    return (F.col("proto") == "udp") & reduce(or_, tests)


def accumulate(packets: DataFrame) -> DataFrame:
    """Sessions with the output columns in order, one for each stream of a file."""
    p = typed(packets)
    is_low = F.col("source") <= F.col("target")
    opening = F.col("syn") & ~F.col("ack")
    answer = F.col("syn") & F.col("ack")
    ends = F.when(opening, F.struct(F.col("source").alias("client"), F.col("target").alias("server"))).when(answer, F.struct(F.col("target").alias("client"), F.col("source").alias("server")))
    shown = F.struct(F.col("source").alias("client"), F.col("target").alias("server"))
    uri = F.col("http_request_uri")
    plain = F.lower(uri)
    decoded = F.lower(F.coalesce(F.try_url_decode(uri), uri))
    suspicious = reduce(or_, (plain.contains(m) | decoded.contains(m) for m in SUSPICIOUS))
    depth = F.size(F.split("frame_protocols", ":")) - 1
    handshakes = F.split("tls_handshake_type", ",")
    upload = F.regexp_extract("mime_multipart_header_content-disposition", r'filename="([^"]*)"', 1)
    one = p.groupBy(*KEYS).agg(
        F.min_by("class_name", "frame").alias("class_name"),
        F.coalesce(F.max_by(F.when(depth > 0, F.col("frame_protocols")), F.when(depth > 0, F.struct(depth.alias("d"), (-F.col("frame")).alias("f")))), F.lit("")).alias("chain"),
        F.coalesce(F.min_by(ends, F.when(ends.isNotNull(), F.col("frame"))), F.min_by(shown, "frame")).alias("ends"),
        F.count("*").alias("pkt_count"),
        F.sum("length").alias("payload_size"),
        F.count_if(is_low).alias("low_pkt"),
        F.coalesce(F.sum(F.when(is_low, F.col("length"))), F.lit(0)).alias("low_byte"),
        F.min("ts").alias("ts_first"),
        F.max("ts").alias("ts_last"),
        F.bool_or(opening).cast("int").alias("has_SYN"),
        F.bool_or(answer).cast("int").alias("has_SYN_ACK"),
        F.bool_or(F.col("fin") & is_low).alias("fin_low"),
        F.bool_or(F.col("fin") & ~is_low).alias("fin_high"),
        F.bool_or("reset").cast("int").alias("has_RST"),
        *[F.bool_or(F.array_contains(handshakes, kind)).cast("int").alias(name) for name, kind in HELLO.items()],
        F.sum(F.size(F.filter(F.split("tls_record_content_type", ","), lambda v: v == HEARTBEAT))).alias("tls_heartbeat"),
        F.count_if(F.col("http_request_method") != "").alias("http_req_count"),
        first_of(F.col("tls_handshake_extensions_server_name")).alias("tls_sni"),
        first_of(uri).alias("http_uri"),
        first_of(F.col("dns_qry_name")).alias("dns_qry"),
        first_of(F.col("http_user_agent")).alias("http_ua"),
        first_of(F.col("http_request_method")).alias("http_method"),
        first_of(F.col("http_host")).alias("http_host"),
        first_of(F.col("http_response_code")).alias("http_resp_code"),
        first_of(F.col("http_content_type")).alias("http_content_type"),
        first_of(uri, (uri != "") & suspicious).alias("http_susp_uri"),
        first_of(F.substring("sip_User-Agent", 1, ITEM_CAP)).alias("sip_ua"),
        first_of(upload).alias("upload_filename"),
        F.coalesce(F.min_by(F.when(F.col("urlencoded-form_key") != "", F.array_join(F.array_distinct(F.split("urlencoded-form_key", ",")), "|")), F.when(F.col("urlencoded-form_key") != "", F.col("frame"))), F.lit("-")).alias("http_post_keys"),
        F.bool_or(F.exists(F.split("urlencoded-form_key", ","), lambda k: F.lower(k) == "botid")).cast("int").alias("has_botid"),
        F.bool_or(_is_probe()).cast("int").alias("is_nmap_probe"),
    )
    info = F.lower("_ws_col_info")
    kept_info = F.when(reduce(or_, (info.contains(m) for m in KEPT_INFO)), info)
    folds = {
        "ws_col_info": (kept_info, INFO_CAP, None, min(map(len, KEPT_INFO))),
        "ftp_arg": (F.col("ftp_request_arg"), ARGUMENT_CAP, ITEM_CAP, 1),
        "ssh_proto": (F.col("ssh_protocol"), ARGUMENT_CAP, ITEM_CAP, 1),
    }
    one = one.join(capped_folds(p, KEYS, "frame", folds), KEYS, "left")
    low = F.col("ends.client") <= F.col("ends.server")
    high_pkt, high_byte = F.col("pkt_count") - F.col("low_pkt"), F.col("payload_size") - F.col("low_byte")
    levels = layers(F.col("chain"))
    done = one.withColumns(
        levels
        | {"session_id": F.concat_ws("_", "proto", "stream"), "noise_label": F.lit("-")}
        | {f"task{n}": task_part(F.col("class_name"), n) for n in (1, 2, 3)}
        | {f"{a}_{b}": F.col(f"ends.{end}.{b}") for a, end in (("src", "client"), ("dst", "server")) for b in ("ip", "port")}
        | {"fwd_pkt": F.when(low, F.col("low_pkt")).otherwise(high_pkt), "bwd_pkt": F.when(low, high_pkt).otherwise(F.col("low_pkt"))}
        | {"fwd_byte": F.when(low, F.col("low_byte")).otherwise(high_byte), "bwd_byte": F.when(low, high_byte).otherwise(F.col("low_byte"))}
        | {"has_FIN_cli": F.when(low, F.col("fin_low")).otherwise(F.col("fin_high")).cast("int"), "has_FIN_serv": F.when(low, F.col("fin_high")).otherwise(F.col("fin_low")).cast("int")}
        | {c: F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in ("ts_first", "ts_last", "ws_col_info", "ftp_arg", "ssh_proto")}
    )
    return done.select(*SESSION_COLUMNS)
