"""The noise rules: one boolean column for each code, marked in one projection.

A rule is a function of the session's safe columns. Marking never shuffles;
reports are one aggregate over the marks. Missing input columns have their
defaults, and every mark is 0 or 1, never null.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netsieve.functions.exprs import is_public, loose_octet, octet, raw_text, safe_int, safe_number, safe_text

# The codes in their order, and the value sets and patterns that the rules test.
CODES = (
    *(f"Aa_{n}" for n in range(1, 8)),
    *(f"Bb_{n}" for n in range(1, 30)),
    *(f"Cc_{n}" for n in range(1, 6)),
    *(f"Cd_{n}" for n in range(1, 5)),
    *(f"De_{n}" for n in range(1, 5)),
    "Df_1",
)
CODE = re.compile(r"^(Aa|Bb|Cc|Cd|De|Df|Eg)_\d+$")
L3_CONTROL = ("arp", "icmp", "icmpv6", "rarp", "teredo")
NAME_RESOLUTION = ("bootp", "dhcp", "dhcpv6", "dns", "llmnr", "mdns", "nbns")
WINDOWS = ("nbdgm", "nbss", "smb", "smb2", "srvloc", "ssdp")
INFRASTRUCTURE = ("chargen", "lsd", "ntp", "rtcp", "snmp", "stun")
DAMAGE = ("packet size limited during capture", "malformed packet", "truncated")
BACKGROUND_SNI = ("javadl-esd-secure.oracle.com", "watson.telemetry.microsoft.com")
TORRENT_L7, TORRENT_PORTS = ("bt-dht", "bt-tracker"), (6969, 61009)
AUTO_L7 = ("bootp", "browser", "dhcp", "dhcpv6", "llmnr", "mdns", "nbdgm", "nbns", "ssdp")
AUTO_PORTS = (67, 68, 137, 138, 546, 547, 1900, 3702, 5353, 5355)
SAFE_L7 = ("bootp", "browser", "cdp", "coap", "dhcp", "dhcpv6", "icmpv6", "igmp", "lldp", "llmnr", "lsd", "mdns", "nbdgm", "nbns", "ntp", "rarp", "ssdp", "stp", "wsdd")
ATTACKERS = (
    "13.58.225.34", "13.58.98.64", "13.59.126.31", "172.31.70.16", "172.31.70.23", "172.31.70.4", "172.31.70.46", "172.31.70.6", "172.31.70.8",
    "18.216.200.189", "18.216.24.42", "18.217.165.70", "18.218.11.51", "18.218.115.60", "18.218.229.235", "18.218.55.126", "18.219.193.20",
    "18.219.211.138", "18.219.32.43", "18.219.5.43", "18.219.9.1", "18.221.219.4", "52.14.136.135",
)
VICTIMS = ("172.31.69.13", "172.31.69.24")
LAB_NET = (205, 174, 165)
PATTERNS = {
    "delivery": r"geo.*\.do\.dsp\.mp\.microsoft\.com|geover.*\.do\.dsp\.mp\.microsoft\.com|kv.*\.prod\.do\.dsp\.mp\.microsoft\.com|cp.*\.prod\.do\.dsp\.mp\.microsoft\.com|disc.*\.prod\.do\.dsp\.mp\.microsoft\.com|array.*\.prod\.do\.dsp\.mp\.microsoft\.com|dl\.delivery\.mp\.microsoft\.com|download\.windowsupdate\.com",
    "ads": r"doubleclick\.net|googlesyndication\.com|googleadservices\.com|googleads\.|google-analytics\.com|adnxs\.com|scorecardresearch\.com|adsystem\.",
    "browser": r"safebrowsing\.google\.com|clients\d+\.google\.com|\.gstatic\.com|\.fbcdn\.net",
    "injection": r"<script|%3cscript|onerror\s*=|onerror%3d|javascript:|javascript%3a|union\s+select|union%20select|select.{1,20}from|\.\./|%2e%2e%2f|/etc/passwd|1=1|1%3d1|' or '|%27.{0,6}or",
    "tracker": r"\.gif\?|/pd\?|/i/1\.gif",
    "auto_dns": r"msftncsi|^wpad$|teredo|isatap|time\.windows\.com",
    "auto_uri": r"msftncsi|wpad\.dat|teredo|isatap|time\.windows\.com",
    "ssh_tool": r"paramiko|libssh2|ganymed|dropbear",
    "hulk": r"\?[A-Z]{3,10}=[A-Z]{3,10}(?:&|$)",
    "goldeneye": r"^/\?[A-Za-z0-9]{0,10}[A-Z0-9][A-Za-z0-9]{0,10}=[A-Za-z0-9]{2,20}(?:&[A-Za-z0-9]{0,10}[A-Z0-9][A-Za-z0-9]{0,10}=[A-Za-z0-9]{2,20}){0,4}$",
    "recon": r"version\.bind|hostname\.bind|id\.server",
    "scanner": r"zgrab|masscan|nmap|nikto|sqlmap|dirbuster|gobuster|hydra|nuclei",
    "sip_scanner": r"friendly-scanner|sipvicious|sundayddr",
    "static": r"\.(?:css|js|png|jpe?g|gif|ico|woff2?|svg)(?:$|\?)",
    "msn": r"msn.com|bing",
}
#: Rules that are removed by default to refine a dataset.
DEFAULTS = {
    "ustc16": ("Aa_2", "Aa_4", "Aa_6", "Aa_7", "Cc_5", "Cd_2", "Bb_7"),
    "cic17": ("Aa_2", "Aa_4", "Aa_6", "Aa_7", "Bb_5", "Bb_8", "Bb_9", "Bb_10", "Bb_11", "Bb_12"),
    "cic18": ("Aa_2", "Aa_4", "Aa_6", "Aa_7", "Bb_13", "Bb_14", "Bb_15", "Bb_16", "Bb_17", "Bb_18", "Bb_19", "Bb_20", "Bb_21", "Bb_22", "Bb_23"),
    "iot23": ("Aa_2", "Aa_4", "Aa_6", "Aa_7", "Bb_24", "Bb_25", "Bb_26"),
    "vpn16": ("Aa_1", "Aa_2", "Aa_4", "Aa_5", "Aa_6", "Aa_7", "Bb_1", "Bb_2", "Bb_3", "Cc_1", "Cc_2", "Cc_3", "Cc_5", "Cd_2", "Cd_3", "Cd_4", "De_1", "De_2", "De_3", "De_4", "Df_1"),
    "tor16": ("Aa_1", "Aa_2", "Aa_4", "Aa_5", "Aa_6", "Aa_7", "Bb_1", "Bb_2", "Cc_1", "Cc_2", "Cc_3", "Cc_5", "Cd_2", "Cd_3", "Cd_4", "De_1", "De_3", "De_4", "Df_1"),
    "tls1.3": ("Aa_2", "Aa_4", "Aa_6", "Aa_7", "Bb_4", "Cc_1", "Cc_2", "Cc_3", "Cc_4", "Cc_5", "Cd_1", "Cd_2", "Cd_3", "Cd_4", "De_1", "De_2", "De_3", "De_4", "Df_1"),
    "cispec": ("Aa_2", "Aa_4", "Aa_5", "Aa_6", "Aa_7", "Cc_1", "Cc_2", "Cc_3", "Cc_4", "Cc_5", "Cd_1", "Cd_2", "Cd_3", "Cd_4", "Df_1"),
}
EXCLUDED = {"cic17": ("damaged", "unlabeled", "double", "none"), "cic18": ("damaged", "double", "none"), "tor16": ("twitter", "aim", "google")}


class Session:
    """The safe columns of a session table, under the names that the rules use."""

    def __init__(self, df: DataFrame, scope: dict[str, list[str]] | None = None) -> None:
        self.l3, self.l4, self.l7, self.src, self.dst, self.info, self.sni, self.uri, self.agent, self.dns = (
            safe_text(df, c) for c in ("L3", "L4", "L7", "src_ip", "dst_ip", "ws_col_info", "tls_sni", "http_uri", "http_ua", "dns_qry")
        )
        self.upload, self.suspicious, self.ftp, self.ssh, self.sip, self.task1, self.task2, self.task3 = (
            safe_text(df, c) for c in ("upload_filename", "http_susp_uri", "ftp_arg", "ssh_proto", "sip_ua", "task1", "task2", "task3")
        )
        self.raw_uri = raw_text(df, "http_uri")
        self.sport, self.dport = safe_int(df, "src_port", -1), safe_int(df, "dst_port", -1)
        flags = ("has_SYN", "has_SYN_ACK", "has_FIN_cli", "has_FIN_serv", "has_RST", "has_TLS_CHLO", "has_TLS_SHLO", "has_botid", "is_nmap_probe")
        self.flag = {c: safe_int(df, c, 0) == 1 for c in flags}
        self.no_fin = (safe_int(df, "has_FIN_cli", 0) == 0) & (safe_int(df, "has_FIN_serv", 0) == 0)
        self.no_syn_ack = safe_int(df, "has_SYN_ACK", 0) == 0
        self.hello_missing = (safe_int(df, "has_TLS_CHLO", 0) == 0) | (safe_int(df, "has_TLS_SHLO", 0) == 0)
        self.payload, self.packets = safe_number(df, "payload_size", 0), safe_int(df, "pkt_count", 0)
        self.duration = safe_number(df, "ts_last", 0) - safe_number(df, "ts_first", 0)
        self.name = F.concat_ws("_", self.task1, self.task2, self.task3)
        self.benign = self.task1 == "benign"
        self.scope = scope or {}

    def port(self, *ports: int) -> Column:
        return self.sport.isin(*ports) | self.dport.isin(*ports)

    def within(self, code: str) -> Column:
        """Whether the class is in the scope that was set for a code; empty scopes hold nothing."""
        return reduce(or_, (self.name.contains(n.lower()) for n in self.scope.get(code, ())), F.lit(False))


def _true(column: Column) -> Column:
    return F.coalesce(column, F.lit(False))


def _cast_to_many(address: Column, first: Column) -> Column:
    """Broadcast, multicast or link-local."""
    ends = address.endswith(".255")  # the limited broadcast address too
    return ends | _true(first.between(224, 239)) | address.startswith("ff") | address.startswith("fe80") | address.startswith("169.254.")


def _lab(s: Session) -> Column:
    a, b, c = LAB_NET
    return reduce(or_, (_true((octet(x, 1) == a) & (octet(x, 2) == b) & (octet(x, 3) == c)) for x in (s.src, s.dst)))


def _quality(s: Session) -> dict[str, Column]:
    tcp = s.l4 == "tcp"
    looks_tls = (s.l7 == "tls") | s.port(443) | s.flag["has_TLS_CHLO"] | s.flag["has_TLS_SHLO"]
    return {
        "Aa_1": tcp & ~(s.flag["has_SYN"] & s.flag["has_SYN_ACK"]),
        "Aa_2": reduce(or_, map(s.info.contains, DAMAGE)),
        "Aa_3": tcp & s.no_fin,
        "Aa_4": s.info.contains("malformed"),
        "Aa_5": tcp & looks_tls & s.hello_missing,
        "Aa_6": s.task1.isin("unlabeled", "double"),
        "Aa_7": s.l3 == "ipv6",
    }


def _general(s: Session) -> dict[str, Column]:
    google = (s.sni.contains("gstatic") | s.sni.contains("google")) & ~s.sni.contains("googlevideo")
    return {
        "Cc_1": s.l7.isin(*L3_CONTROL) | s.l3.isin("ipv6", "arp", "rarp") | s.l4.isin("icmp", "icmpv6"),
        "Cc_2": s.l7.isin(*NAME_RESOLUTION),
        "Cc_3": s.l7.isin(*WINDOWS),
        "Cc_4": s.l7.isin(*INFRASTRUCTURE),
        "Cc_5": _cast_to_many(s.dst, loose_octet(s.dst, 1)),
        "Cd_1": s.l7.isin(*TORRENT_L7) | s.port(*TORRENT_PORTS),
        "Cd_2": (s.agent == "winhttp") | s.sni.isin(*BACKGROUND_SNI) | s.dns.contains("msftncsi") | s.uri.contains("msftncsi"),
        "Cd_3": s.sni.rlike(PATTERNS["delivery"]),
        "Cd_4": s.agent.contains("apt-http"),
        "De_1": google & s.l7.isin("tls", "gquic"),
        "De_2": s.sni.contains("mail"),
        "De_3": s.sni.rlike(PATTERNS["ads"]),
        "De_4": s.sni.rlike(PATTERNS["browser"]),
        "Df_1": s.uri.rlike(PATTERNS["msn"]),
    }


def _applications(s: Session) -> dict[str, Column]:
    network_control = s.l7.isin(*L3_CONTROL, *NAME_RESOLUTION, *WINDOWS, *INFRASTRUCTURE)
    voip_media = s.name.contains("voip") & s.l7.isin("stun", "rtcp")
    peer_class = s.name.contains("bittorrent") | (s.task2 == "p2p")
    wrong_l7 = (s.name.contains("scp") & (s.l7 != "ssh")) | (s.name.contains("ftp") & (s.l7 == "sip"))
    both = ~s.sni.isin("", "-") & ~s.task3.isin("", "-")
    return {
        "Bb_1": s.l7.isin(*INFRASTRUCTURE) & ~voip_media,
        "Bb_2": (s.l7.isin(*TORRENT_L7) | s.port(*TORRENT_PORTS)) & ~peer_class,
        "Bb_3": wrong_l7 & ~network_control,
        "Bb_4": both & (s.sni != s.task3) & ~s.sni.endswith(F.concat(F.lit("."), s.task3)),
    }


def _mislabelled_benign(s: Session) -> dict[str, Column]:
    injected = s.suspicious.rlike(PATTERNS["injection"]) & ~s.suspicious.rlike(PATTERNS["tracker"])
    hulk = s.raw_uri.rlike(PATTERNS["hulk"])
    scanned = s.dns.rlike(PATTERNS["recon"]) | s.agent.rlike(PATTERNS["scanner"]) | s.sip.rlike(PATTERNS["sip_scanner"])
    inside = s.src.isin(*VICTIMS) & s.dst.startswith("172.31.69.") & s.flag["has_SYN"] & s.no_syn_ack
    marks = {
        "Bb_5": s.flag["has_botid"] | ~s.upload.isin("", "-", "0") | injected,
        "Bb_9": s.ftp.contains("\\t"),
        "Bb_10": s.ssh.rlike(PATTERNS["ssh_tool"]),
        "Bb_11": hulk,
        "Bb_12": ~hulk & s.raw_uri.rlike(PATTERNS["goldeneye"]),
        "Bb_13": s.src.isin(*ATTACKERS) | s.dst.isin(*ATTACKERS),
        "Bb_14": scanned,
        "Bb_23": inside,
        "Bb_27": s.flag["is_nmap_probe"],
    }
    return {code: s.benign & mark for code, mark in marks.items()}


def _mislabelled_attack(s: Session) -> dict[str, Column]:
    carrier = (loose_octet(s.dst, 1) == 100) & loose_octet(s.dst, 2).between(64, 127)
    automatic = s.l7.isin(*AUTO_L7) | s.port(*AUTO_PORTS) | s.l3.isin("arp", "rarp") | (s.l4 == "icmpv6") | s.dns.rlike(PATTERNS["auto_dns"]) | s.uri.rlike(PATTERNS["auto_uri"])
    source, target = is_public(s.src), is_public(s.dst)
    first = F.trim(F.split_part(s.dst, F.lit(","), F.lit(1)))
    many = _cast_to_many(first, octet(s.dst, 1))
    internal = octet(s.src, 1).isNotNull() & octet(s.dst, 1).isNotNull() & ~source & ~target
    outside_lab = ~_lab(s)
    marks = {
        "Bb_6": (s.l4 == "udp") & _true(carrier) & (s.dport == 7001),
        "Bb_7": automatic,
        "Bb_24": (source | target) & outside_lab,
        "Bb_25": internal & ~many & outside_lab & s.l7.isin(*SAFE_L7),
        "Bb_26": many & outside_lab,
    }
    return {code: ~s.benign & mark for code, mark in marks.items()}


def _by_class(s: Session) -> dict[str, Column]:
    single = s.flag["has_SYN"] & s.no_syn_ack & (s.packets == 1)
    empty = s.payload == 0
    return {
        "Bb_8": s.name.contains("infiltration"),
        "Bb_15": s.name.contains("ftp-patator"),
        "Bb_16": s.name.contains("slowhttptest"),
        "Bb_17": s.name.contains("ssh-patator") & (s.dport == 21),
        "Bb_18": s.name.contains("loic-udp") & (s.l4 == "icmp"),
        "Bb_19": s.name.contains("slowloris") & empty,
        "Bb_20": s.name.contains("goldeneye") & s.flag["has_RST"] & (s.duration < 5.05),
        "Bb_21": s.name.contains("web-attack") & s.uri.rlike(PATTERNS["static"]),
        "Bb_22": s.name.contains("_bot") & empty,
        "Bb_28": s.within("Bb_28") & single & (s.l4 == "tcp"),
        "Bb_29": s.within("Bb_29") & single,
    }


Family = Callable[[Session], dict[str, Column]]
FAMILIES: list[Family] = [_quality, _applications, _mislabelled_benign, _mislabelled_attack, _by_class, _general]


def marks(df: DataFrame, scope: dict[str, list[str]] | None = None, families: Iterable[Family] = ()) -> dict[str, Column]:
    """Every code's condition, in order. Further families may add codes; a code given twice holds where either does."""
    session = Session(df, scope)
    found: dict[str, Column] = {}
    for family in (*FAMILIES, *families):
        for code, condition in family(session).items():
            found[code] = found[code] | _true(condition) if code in found else _true(condition)
    order = {code: k for k, code in enumerate(CODES)}
    return dict(sorted(found.items(), key=lambda x: order.get(x[0], len(order))))


def mark(df: DataFrame, scope: dict[str, list[str]] | None = None, families: Iterable[Family] = ()) -> DataFrame:
    """df with a column of 0 and 1 for each code; columns that had these names are replaced."""
    found = marks(df, scope, families)
    return df.select(*[c for c in df.columns if c not in found], *[x.cast("int").alias(code) for code, x in found.items()])


def codes_of(df: DataFrame) -> list[str]:
    return [c for c in df.columns if CODE.match(c)]


def is_marked(df: DataFrame, code: str) -> Column:
    """1 and, in text, the spellings of true count as marked."""
    if dict(df.dtypes)[code] == "int":
        return F.coalesce(F.col(code) == 1, F.lit(False))
    return F.coalesce(F.col(code).cast("string").isin("1", "True", "TRUE", "true"), F.lit(False))


def any_mark(df: DataFrame, codes: Iterable[str] | None = None) -> Column:
    """Whether any of the codes that the table has is marked."""
    present = codes_of(df)
    chosen = [c for c in (present if codes is None else codes) if c in present]
    return reduce(or_, (is_marked(df, c) for c in chosen), F.lit(False))


def default_codes(dataset: str) -> list[str]:
    return list(DEFAULTS[dataset])


def report(marked: DataFrame) -> DataFrame:
    """One row: sessions, with any mark, with two or more, and those of each code."""
    codes = codes_of(marked)
    n = sum((is_marked(marked, c).cast("int") for c in codes), F.lit(0))
    each = [F.sum(is_marked(marked, c).cast("long")).alias(c) for c in codes]
    return marked.agg(F.count("*").alias("total"), F.count_if(n >= 1).alias("any_noise"), F.count_if(n >= 2).alias("multi_noise"), *each)


def per_rule(marked: DataFrame) -> DataFrame:
    """(rule, sessions): how many sessions each code marks, counted apart."""
    codes = codes_of(marked)
    totals = marked.agg(*[F.sum(is_marked(marked, c).cast("long")).alias(c) for c in codes])
    pairs = ", ".join(f"'{c}', `{c}`" for c in codes)
    return totals.selectExpr(f"stack({len(codes)}, {pairs}) AS (rule, sessions)")


def per_class(marked: DataFrame, codes: Iterable[str], group: Column, name: Column) -> DataFrame:
    """(group, class, before, after, removed, vanished) with the rules of ``codes`` removed."""
    noisy = any_mark(marked, codes)
    counted = marked.groupBy(group.alias("group"), name.alias("class")).agg(F.count("*").alias("before"), F.count_if(~noisy).alias("after"))
    return counted.select("*", (F.col("before") - F.col("after")).alias("removed"), (F.col("after") == 0).cast("int").alias("vanished"))
