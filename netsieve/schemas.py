"""Names and types of the tables that operators read and write."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Packet fields and session columns in their order.
FIELDS = (
    "frame.number", "frame.protocols", "tcp.stream", "udp.stream", "ip.src", "ipv6.src", "ip.dst", "ipv6.dst", "tcp.srcport", "udp.srcport", "tcp.dstport", "udp.dstport",
    "tcp.len", "udp.length", "tcp.flags.syn", "tcp.flags.ack", "tcp.flags.fin", "tls.handshake.type", "tls.handshake.extensions_server_name", "http.request.uri",
    "dns.qry.name", "http.user_agent", "_ws.col.info", "frame.time_epoch", "tcp.flags.reset", "tls.record.content_type", "http.request.method", "http.host",
    "http.response.code", "http.content_type", "urlencoded-form.key", "mime_multipart.header.content-disposition", "ftp.request.arg", "ssh.protocol", "udp.payload", "sip.User-Agent",
)
SESSION_COLUMNS = (
    "filename", "session_id", "task1", "task2", "task3", "noise_label", "L2", "L3", "L4", "L7", "src_ip", "src_port", "dst_ip", "dst_port", "pkt_count", "payload_size",
    "fwd_pkt", "fwd_byte", "bwd_pkt", "bwd_byte", "ts_first", "ts_last", "ws_col_info", "has_SYN", "has_SYN_ACK", "has_FIN_cli", "has_FIN_serv", "has_TLS_CHLO",
    "has_TLS_SHLO", "tls_sni", "http_uri", "dns_qry", "http_ua", "has_RST", "tls_heartbeat", "http_method", "http_host", "http_resp_code", "http_req_count",
    "http_susp_uri", "http_content_type", "http_post_keys", "upload_filename", "has_botid", "ftp_arg", "ssh_proto", "is_nmap_probe", "sip_ua",
)
LIST_COLUMNS = ("filename", "session_id", "proto", "stream", "group_key", "task1", "task2", "task3")

PACKETS = T.StructType([T.StructField(name, T.StringType()) for name in FIELDS])


def with_defaults(df: DataFrame, names: Iterable[str], default: str) -> DataFrame:
    """df with the named text columns, nulls and missing ones being the default; others are dropped."""
    have = set(df.columns)
    return df.select(*[(F.coalesce(F.col(f"`{n}`").cast("string"), F.lit(default)) if n in have else F.lit(default)).alias(n) for n in names])
