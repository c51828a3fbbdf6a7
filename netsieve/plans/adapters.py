"""Views of the driver's tables in the shapes that the operators read.

The projections are plain SQL that means the same to Spark and to other
engines, so a check can start from the same rows without sharing any operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(selector: str, values: list[str]) -> str:
    """SQL for the selector-th of some texts, round and round."""
    cases = " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(values))
    return f"CASE ({selector}) % {len(values)} {cases} END"


#: Session-like columns made from an event's numbers: every rule meets both of its outcomes.
_E, _U = "event_id", "user_id"
_CLASSES = [
    "Benign_Benign_Benign", "Malware_DoS_GoldenEye", "Benign_web_example.com", "Malware_Web-Attack_XSS", "VPN_voip_skype", "Benign_p2p_bittorrent", "unlabeled_none_none", "Malware_Patator_SSH-Patator",
    "App_file_scp", "Malware_DoS_Slowloris", "Double_none_none", "Malware_Patator_FTP-Patator", "Malware_DDoS_LOIC-UDP", "Malware_Infiltration_Infiltration", "Malware_DoS_Slowhttptest", "Malware_x_Bot",
]
MARKABLE = {
    "event_id": _E,
    "filename": f"'f' || CAST({_U} % 7 AS STRING) || '.pcap'",
    "session_id": f"CASE {_E} % 3 WHEN 0 THEN 'udp_' ELSE 'tcp_' END || CAST({_E} AS STRING)",
    "task1": f"CASE {_E} % 16 WHEN 4 THEN 'VPN' WHEN 6 THEN 'unlabeled' WHEN 8 THEN 'App' WHEN 10 THEN 'Double' WHEN 0 THEN 'Benign' WHEN 2 THEN 'Benign' WHEN 5 THEN 'benign' ELSE 'Malware' END",
    "task2": pick(_E, [c.split("_")[1] for c in _CLASSES]),
    "task3": pick(_E, [c.split("_")[2] for c in _CLASSES]),
    "L3": pick(f"{_E} * 5 + {_U}", ["ip", "ip", "ip", "ipv6", "arp", "ip", "ip"]),
    "L4": pick(f"{_E} * 3 + {_U} * 2", ["tcp", "tcp", "udp", "icmp", "tcp"]),
    "L7": pick(f"{_E} * 7 + {_U} * 3", ["tls", "http", "dns", "ssh", "stun", "bt-dht", "smb2", "mdns", "sip", "icmpv6", "gquic", "ntp", "-"]),
    "src_ip": pick(f"{_E} + {_U} * 5", ["10.0.0.5", "172.31.69.13", "18.221.219.4", "205.174.165.70", "8.8.8.8", "192.168.1.9", "fe80::1", "-", "10.1.2.3,4.4.4.4"]),
    "dst_ip": pick(f"{_E} * 2 + {_U} * 7", ["10.0.0.255", "172.31.69.25", "100.64.0.9", "224.0.0.251", "1.2.3.4", "192.168.0.5,10.1.1.255", "ff02::2", "169.254.3.4", "205.174.165.8", "52.14.136.135", "255.255.255.255"]),
    "src_port": f"CASE {_E} % 6 WHEN 0 THEN '443' WHEN 1 THEN '6969' WHEN 2 THEN '5353' WHEN 3 THEN '-' WHEN 4 THEN '51000.0' ELSE '40001' END",
    "dst_port": f"CASE ({_E} + {_U}) % 8 WHEN 0 THEN '443' WHEN 1 THEN '7001' WHEN 2 THEN '21' WHEN 3 THEN '137' WHEN 4 THEN '61009' WHEN 5 THEN '' ELSE '8080' END",
    "ws_col_info": pick(f"{_E} + {_U} * 3", ["-", "Malformed Packet", "tcp dup ack", "[truncated] x", "packet size limited during capture", "-", "-"]),
    "has_SYN": f"CAST(({_E} + {_U}) % 2 AS STRING)",
    "has_SYN_ACK": f"CAST({_E} % 3 % 2 AS STRING)",
    "has_FIN_cli": f"CAST({_U} % 2 AS STRING)",
    "has_FIN_serv": f"CAST({_E} % 5 % 2 AS STRING)",
    "has_RST": f"CAST({_U} % 3 % 2 AS STRING)",
    "has_TLS_CHLO": f"CAST({_E} % 2 AS STRING)",
    "has_TLS_SHLO": f"CAST({_E} % 4 % 3 % 2 AS STRING)",
    "has_botid": f"CASE {_E} % 23 WHEN 0 THEN '1' ELSE '0' END",
    "is_nmap_probe": f"CASE {_E} % 29 WHEN 0 THEN '1.0' ELSE '' END",
    "tls_sni": pick(f"{_E} * 3 + {_U}", ["-", "a.example.com", "badexample.com", "www.google.com", "fonts.gstatic.com", "r3.googlevideo.com", "mail.x.org", "stats.doubleclick.net", "safebrowsing.google.com", "kv1.prod.do.dsp.mp.microsoft.com", "watson.telemetry.microsoft.com", "", "example.com"]),
    "http_uri": pick(f"{_E} + {_U} * 11", ["-", "/?ABCD=EFGH", "/?abcd=efgh", "/?aB1=xy&cD=zz", "/a/b.css", "/msnxcom", "/img.png?x=1", "/wpad.dat", "/bing/search", "/msftncsi.txt", ""]),
    "dns_qry": pick(f"{_E} * 2 + {_U}", ["-", "wpad", "version.bind", "time.windows.com", "dns.msftncsi.com", "example.org", "id.server"]),
    "http_ua": pick(f"{_E} + {_U}", ["-", "WinHTTP", "Debian APT-HTTP/1.3", "sqlmap/1.0", "Mozilla/5.0", "zgrab"]),
    "http_susp_uri": pick(f"{_E} + {_U} * 2", ["-", "/x?q=<script>", "/etc/passwd", "/a.gif?1=1", "/p?id=1 UNION  SELECT 2", "-", "-"]),
    "upload_filename": pick(f"{_E} * 5 + {_U}", ["-", "0", "", "-", "shell.php", "-", "-", "-"]),
    "ftp_arg": f"CASE {_E} % 19 WHEN 0 THEN 'user' || chr(92) || 't' ELSE '-' END",
    "ssh_proto": pick(f"{_E} + {_U} * 4", ["-", "SSH-2.0-OpenSSH", "SSH-2.0-paramiko_2", "-", "-"]),
    "sip_ua": pick(f"{_E} * 11", ["-", "-", "friendly-scanner", "-", "x", "-", "-"]),
    "payload_size": f"CASE {_E} % 4 WHEN 0 THEN '0' ELSE CAST({_U} AS STRING) END",
    "pkt_count": f"CAST({_E} % 3 + 1 AS STRING)",
    "ts_first": f"CASE {_E} % 10 WHEN 0 THEN '-' ELSE CAST({_E} AS STRING) || '.5' END",
    "ts_last": f"CASE {_E} % 10 WHEN 0 THEN '-' ELSE CAST({_E} + {_U} % 9 AS STRING) || '.25' END",
}


def markable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*[f"{sql} AS {name}" for name, sql in MARKABLE.items()])


def markable_sql() -> str:
    return "SELECT " + ", ".join(f"{sql} AS {name}" for name, sql in MARKABLE.items()) + " FROM events"


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as packets: the session is a user's day, order is (t, event_id), and the sign tells the direction."""
    e = table(spark, sf_dir, "events")
    micros = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    return e.select("event_id", "user_id", F.floor(micros / 86_400_000_000).alias("day"), (micros / 1e6).alias("t"), micros.alias("us"), "event_type", "value")


PACKETS_SQL = "SELECT event_id, user_id, floor(epoch_us(ts) / 86400000000)::BIGINT AS day, epoch_us(ts) / 1e6 AS t, epoch_us(ts) AS us, event_type, value FROM events"
