"""Captures to packet rows: files come through Spark's own reader, bytes are walked in Arrow batches.

A capture is one row of at most 2 GB, as Spark's binary reader gives it. Packets
before a damaged end are kept; a file that is no capture gives no rows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from netsieve.schemas import FIELDS

SCHEMA = "filename string, class_name string, frame long, ts double, linktype int, ipver int, proto string, ip_hdr_len int, l4_hdr_len int, src string, dst string, sport int, dport int, flags string, raw binary"
ARROW = pa.schema(
    [
        ("filename", pa.string()), ("class_name", pa.string()), ("frame", pa.int64()), ("ts", pa.float64()), ("linktype", pa.int32()), ("ipver", pa.int32()), ("proto", pa.string()), ("ip_hdr_len", pa.int32()),
        ("l4_hdr_len", pa.int32()), ("src", pa.string()), ("dst", pa.string()), ("sport", pa.int32()), ("dport", pa.int32()), ("flags", pa.string()), ("raw", pa.binary()),
    ]
)
MAGIC = {0xA1B2C3D4: 1e6, 0xA1B23C4D: 1e9}
SECTION, INTERFACE, ENHANCED = 0x0A0D0D0A, 1, 6
FLAG_ORDER = "FSRPAUEC"
ROWS = 5000


def kind(content: bytes) -> str:
    """pcap, pcapng or other, by the first four bytes."""
    if len(content) < 4:
        return "other"
    little, big = struct.unpack("<I", content[:4])[0], struct.unpack(">I", content[:4])[0]
    return "pcapng" if little == SECTION else "pcap" if little in MAGIC or big in MAGIC else "other"


def packets(content: bytes) -> Iterator[tuple[float, int, bytes]]:
    """(time, linktype, bytes) of each whole packet."""
    form = kind(content)
    if form == "pcap" and len(content) >= 24:
        order = "<" if struct.unpack("<I", content[:4])[0] in MAGIC else ">"
        unit, link = MAGIC[struct.unpack(order + "I", content[:4])[0]], struct.unpack(order + "I", content[20:24])[0] & 0xFFFF
        at = 24
        while at + 16 <= len(content):
            seconds, part, size, _ = struct.unpack_from(order + "4I", content, at)
            if at + 16 + size > len(content):
                return
            yield seconds + part / unit, link, content[at + 16 : at + 16 + size]
            at += 16 + size
    elif form == "pcapng":
        at, order, links = 0, "<", []
        while at + 12 <= len(content):
            block, size = struct.unpack_from(order + "II", content, at)
            if block == SECTION:
                order = "<" if content[at + 8 : at + 12] == b"\x4d\x3c\x2b\x1a" else ">"
                size, links = struct.unpack_from(order + "I", content, at + 4)[0], []
            if size < 12 or at + size > len(content):
                return
            if block == INTERFACE:
                links.append(_interface(content[at + 8 : at + size - 4], order))
            elif block == ENHANCED:
                where, high, low, length = struct.unpack_from(order + "4I", content, at + 8)
                if where < len(links):
                    yield ((high << 32) + low) / links[where][1], links[where][0], content[at + 28 : at + 28 + length]
            at += size


def _interface(body: bytes, order: str) -> tuple[int, float]:
    """Link type and units a second of an interface block."""
    unit, at = 1e6, 8
    while at + 4 <= len(body):
        code, size = struct.unpack_from(order + "HH", body, at)
        if code == 0:
            break
        if code == 9 and size:
            unit = float(2 ** (body[at + 4] & 127)) if body[at + 4] & 128 else 10.0 ** body[at + 4]
        at += 4 + (size + 3) // 4 * 4
    return struct.unpack_from(order + "H", body)[0], unit


def network_layer(link: int, data: bytes) -> bytes:
    """The bytes from the IP header on; nothing if there is none."""
    if link == 1:  # Ethernet, with any VLAN tags
        at = 12
        while data[at : at + 2] in (b"\x81\x00", b"\x88\xa8"):
            at += 4
        return data[at + 2 :] if data[at : at + 2] in (b"\x08\x00", b"\x86\xdd") else b""
    skip = {0: 4, 108: 4, 113: 16, 276: 20}.get(link, 0)
    data = data[skip:]
    return data if data[:1] and data[0] >> 4 in (4, 6) else b""


def view(link: int, data: bytes) -> dict:
    """Addresses, ports, header lengths and flags of a packet; other fields are null without IP."""
    raw = network_layer(link, data)
    found: dict = {"raw": raw or data}
    version = raw[0] >> 4 if raw else 0
    if version == 4 and len(raw) >= 20:
        size, protocol = (raw[0] & 15) * 4, raw[9]
        found |= {"src": ".".join(map(str, raw[12:16])), "dst": ".".join(map(str, raw[16:20]))}
    elif version == 6 and len(raw) >= 40:
        size, protocol = 40, raw[6]
        while protocol in (0, 43, 44, 60) and size + 8 <= len(raw):  # extension headers
            protocol, size = raw[size], size + (8 if protocol == 44 else (raw[size + 1] + 1) * 8)
        found |= {end: ":".join(f"{x:x}" for x in struct.unpack("!8H", raw[a : a + 16])) for end, a in (("src", 8), ("dst", 24))}
    else:
        return found
    found |= {"ipver": version, "ip_hdr_len": size, "proto": {1: "icmp", 6: "tcp", 17: "udp", 47: "gre", 58: "icmpv6"}.get(protocol, str(protocol))}
    segment = raw[size:]
    if protocol == 6 and len(segment) >= 20:
        bits = segment[13]
        found |= {"l4_hdr_len": (segment[12] >> 4) * 4, "flags": "".join(c for k, c in enumerate(FLAG_ORDER) if bits >> k & 1)}
    elif protocol == 17 and len(segment) >= 8:
        found |= {"l4_hdr_len": 8}
    if "l4_hdr_len" in found:
        found["sport"], found["dport"] = struct.unpack("!HH", segment[:4])
    return found


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for batch in batches:
        for name, class_name, content in zip(*(batch.column(k) for k in range(3)), strict=True):
            for frame, (ts, link, data) in enumerate(packets(content.as_py() or b""), 1):
                held.append({"filename": name.as_py(), "class_name": class_name.as_py(), "frame": frame, "ts": ts, "linktype": link} | view(link, data))
                if len(held) >= ROWS:
                    yield pa.RecordBatch.from_pylist(held, schema=ARROW)
                    held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=ARROW)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Packet rows of the captures under a path; class_name is a capture's folder."""
    parts = F.split("path", "/")
    files = spark.read.format("binaryFile").load(path).select(F.element_at(parts, -1).alias("filename"), F.element_at(parts, -2).alias("class_name"), "content")
    return files.mapInArrow(_rows, SCHEMA)


def unreadable(spark: SparkSession, path: str) -> DataFrame:
    """(path, reason) of the files under a path that give no packets; Spark's reader leaves out files of no bytes itself."""
    head = spark.read.format("binaryFile").load(path).select("path", "length", F.hex(F.substring("content", 1, 4)).alias("magic"))
    known = F.col("magic").isin("A1B2C3D4", "D4C3B2A1", "A1B23C4D", "4D3CB2A1", "0A0D0D0A")
    reason = F.when(~known, "no capture").when(F.col("length") <= 24, "no packets")
    return head.select("path", reason.alias("reason")).where("reason IS NOT NULL")


def index(files: DataFrame, name: str, root: str) -> DataFrame:
    """One path for each file name: that of the root that comes first."""
    return files.groupBy(name).agg(F.min_by("path", F.struct(root, "path")).alias("path"))


def _ends() -> Column:
    a, b = (F.struct(F.col(f"{way}").alias("ip"), F.col(port).alias("port")) for way, port in (("src", "sport"), ("dst", "dport")))
    return F.struct(F.least(a, b).alias("low"), F.greatest(a, b).alias("high"))


def streams(rows: DataFrame) -> DataFrame:
    """TCP and UDP rows with ``stream``, the number of their conversation in order of its first frame, from 0 in each file and protocol.

    A conversation is a pair of ends; ports that are used again later stay in
    it. Packets meet in a partial aggregate, and only conversations are put in order.
    """
    known = rows.where(F.col("proto").isin("tcp", "udp") & F.col("sport").isNotNull()).withColumn("_ends", _ends())
    firsts = known.groupBy("filename", "proto", "_ends").agg(F.min("frame").alias("_first"))
    number = F.row_number().over(Window.partitionBy("filename", "proto").orderBy("_first")) - 1
    return known.join(firsts.withColumn("stream", number.cast("long")).drop("_first"), ["filename", "proto", "_ends"]).select(*rows.columns, "stream")


#: Names of link types in a chain of protocols.
LINKS = {0: "null", 1: "eth", 101: "raw", 108: "loop", 113: "sll", 276: "sll2"}


def _number(start: Column | int) -> Column:
    """The 16-bit number at a byte (from 0) of raw."""
    start = F.lit(start) if isinstance(start, int) else start
    return F.conv(F.hex(F.substr("raw", start + 1, F.lit(2))), 16, 10).cast("int")


def fields(rows: DataFrame) -> DataFrame:
    """Rows with streams as the text fields that sessions are made of: filename, class_name and FIELDS.

    Headers, lengths and flags come from the packet; of the layers above only
    what the text of one packet shows of HTTP. Fields that need a dissector of
    other protocols, or streams put together, are empty.
    """
    tcp, six = F.col("proto") == "tcp", F.col("ipver") == 6
    below = F.col("ip_hdr_len")
    size = F.when(six, _number(4) + 40).otherwise(_number(2))
    payload = F.substr("raw", below + F.col("l4_hdr_len") + 1, F.greatest(size - below - F.col("l4_hdr_len"), F.lit(0)))
    text = F.decode(payload, "ISO-8859-1")
    head = r"^([A-Z]{3,7}) (\S+) HTTP/1\.[01]\r\n"

    def header(name: str) -> Column:
        return F.regexp_extract(text, rf"(?is)^(?:[A-Z]{{3,7}} \S+ HTTP/1\.|HTTP/1\.).*?\r\n{name}:[ \t]*([^\r\n]*)", 1)

    method = F.regexp_extract(text, head, 1)
    link = F.create_map(*[F.lit(x) for pair in LINKS.items() for x in pair])[F.col("linktype")]
    shows_http = (method != "") | text.startswith("HTTP/1.")
    chain = F.concat_ws(":", link, F.when(six, "ipv6").otherwise("ip"), "proto", F.when(shows_http, "http"))
    found = {
        "frame.number": F.col("frame"),
        "frame.protocols": chain,
        "frame.time_epoch": F.format_string("%.6f", "ts"),
        "tcp.len": F.when(tcp, F.octet_length(payload)),
        "udp.length": F.when(~tcp, _number(below + 4)),
        "udp.payload": F.when(~tcp, F.lower(F.hex(payload))),
        **{f"{proto}.stream": F.when(F.col("proto") == proto, F.col("stream")) for proto in ("tcp", "udp")},
        **{f"{proto}.{way}port": F.when(F.col("proto") == proto, F.col(f"{way[0]}port")) for proto in ("tcp", "udp") for way in ("src", "dst")},
        **{f"{ip}.{way}": F.when(six == (ip == "ipv6"), F.col(way)) for ip in ("ip", "ipv6") for way in ("src", "dst")},
        **{f"tcp.flags.{name}": F.when(tcp, F.contains("flags", F.lit(letter)).cast("int")) for name, letter in (("syn", "S"), ("ack", "A"), ("fin", "F"), ("reset", "R"))},
        "http.request.method": method,
        "http.request.uri": F.regexp_extract(text, head, 2),
        "http.host": F.when(method != "", header("Host")),
        "http.user_agent": F.when(method != "", header("User-Agent")),
        "http.response.code": F.regexp_extract(text, r"^HTTP/1\.[01] (\d{3})", 1),
        "http.content_type": F.when(method == "", header("Content-Type")),
    }
    none = F.lit("")
    return rows.select("filename", "class_name", *[F.coalesce(found[name].cast("string"), none).alias(name) if name in found else none.alias(name) for name in FIELDS])
