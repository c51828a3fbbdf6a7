"""SQL for DuckDB that says the same as the queries, written apart from the operators."""

from __future__ import annotations

from netsieve.plans.adapters import PACKETS_SQL, markable_sql
from netsieve.plans.queries import CHAINS, SCHEDULE

ORACLES: dict[str, str] = {}
P, M = f"p AS ({PACKETS_SQL})", f"m0 AS ({markable_sql()})"

ORACLES["session_accumulate"] = f"""
    WITH {P} SELECT user_id, day, count(*) AS pkt_count, round(sum(value), 4) AS payload, min(us) AS first_us, max(us) AS last_us,
        bool_or(event_type = 'signup')::INT AS has_syn, bool_or(event_type = 'purchase')::INT AS has_fin, bool_or(event_type = 'error')::INT AS has_rst FROM p GROUP BY 1, 2"""

_DIRECTION = f"""{P}, f AS (SELECT user_id, day, arg_min(event_type, (us, event_id)) AS client FROM p GROUP BY 1, 2),
    d AS (SELECT user_id, day, client, count(*) FILTER (event_type = client) AS fwd_pkt, coalesce(sum(value) FILTER (event_type = client), 0) AS fwd_byte,
        count(*) FILTER (event_type <> client) AS bwd_pkt, coalesce(sum(value) FILTER (event_type <> client), 0) AS bwd_byte FROM p JOIN f USING (user_id, day) GROUP BY 1, 2, 3)"""
ORACLES["session_direction"] = f"WITH {_DIRECTION} SELECT user_id, day, client, fwd_pkt, round(fwd_byte, 4) AS fwd_byte, bwd_pkt, round(bwd_byte, 4) AS bwd_byte FROM d"
ORACLES["first_nonempty"] = "SELECT conv_id, md5(coalesce(arg_min(text, turn) FILTER (role = 'assistant' AND text <> ''), '-')) AS first_answer FROM conversations GROUP BY 1"
ORACLES["ordered_distinct_capped"] = f"""
    WITH {P}, f AS (SELECT user_id, day, event_type, min(us) AS o FROM p GROUP BY 1, 2, 3),
    c AS (SELECT *, sum(length(event_type)) OVER (PARTITION BY user_id, day ORDER BY o, event_type ROWS UNBOUNDED PRECEDING) - length(event_type) AS before FROM f)
    SELECT user_id, day, string_agg(event_type, ' || ' ORDER BY o, event_type) AS event_type FROM c WHERE before < 12 GROUP BY 1, 2"""

_LAYERS = {"eth:ethertype:ip:tcp:tls": "eth ip tcp tls", "eth:ip:udp:dns": "eth ip udp dns", "sll:ipv6:tcp:http:data": "sll ipv6 tcp http", "eth:ip:tcp:nbss:smb2": "eth ip tcp smb2", "eth:arp": "eth arp - -", "raw:ip:icmp": "raw ip icmp -", "eth:ip:udp:data": "eth ip udp -", "eth:ip:gre:ip:udp:stun": "eth ip gre stun"}
ORACLES["layer_classify"] = "SELECT event_id, " + ", ".join(
    f"CASE event_id % {len(CHAINS)} " + " ".join(f"WHEN {k} THEN '{_LAYERS[chain].split()[n]}'" for k, chain in enumerate(CHAINS)) + f" END AS {name}" for n, name in enumerate(("L2", "L3", "L4", "L7"))
) + " FROM events"
ORACLES["task_split"] = "SELECT p_partkey, " + ", ".join(f"coalesce(nullif(split_part(replace(p_name, ' ', '_'), '_', {n}), ''), '-') AS task{n}" for n in (1, 2, 3)) + " FROM part"

# Rules: safe columns first, then a predicate for each code.
_TEXT = ("L3", "L4", "L7", "src_ip", "dst_ip", "ws_col_info", "tls_sni", "http_uri", "http_ua", "dns_qry", "upload_filename", "http_susp_uri", "ftp_arg", "ssh_proto", "sip_ua", "task1", "task2", "task3")
_NUMBER = {"src_port": -1, "dst_port": -1} | dict.fromkeys(("has_SYN", "has_SYN_ACK", "has_FIN_cli", "has_FIN_serv", "has_RST", "has_TLS_CHLO", "has_TLS_SHLO", "has_botid", "is_nmap_probe", "payload_size", "pkt_count", "ts_first", "ts_last"), 0)
_SAFE = "SELECT event_id, http_uri AS raw_uri, " + ", ".join(f"lower(trim(coalesce({c}, ''))) AS {c}" for c in _TEXT) + ", " + ", ".join(f"coalesce(try_cast({c} AS DOUBLE), {d}) AS {c}" for c, d in _NUMBER.items()) + " FROM m0"
_OCTETS = ", ".join(f"try_cast(nullif(regexp_extract(split_part({a}_ip, ',', 1), '^\\s*(\\d{{1,3}})\\.(\\d{{1,3}})\\.(\\d{{1,3}})\\.(\\d{{1,3}})\\s*$', {n}), '') AS INT) AS {a[0]}{n}" for a in ("src", "dst") for n in (1, 2, 3))
_MORE = f"""SELECT *, task1 || '_' || task2 || '_' || task3 AS cls, task1 = 'benign' AS benign, trim(split_part(dst_ip, ',', 1)) AS dst1, {_OCTETS},
    try_cast(split_part(dst_ip, '.', 1) AS DOUBLE) AS r1, try_cast(split_part(dst_ip, '.', 2) AS DOUBLE) AS r2 FROM s0"""
_PUBLIC = "({0}1 IS NOT NULL AND NOT ({0}1 IN (10, 127, 0) OR ({0}1 = 172 AND {0}2 BETWEEN 16 AND 31) OR ({0}1 = 192 AND {0}2 = 168) OR ({0}1 = 169 AND {0}2 = 254) OR {0}1 >= 224))"
_FLAGS = f"""SELECT *, {_PUBLIC.format('s')} AS spub, {_PUBLIC.format('d')} AS dpub,
    coalesce((s1 = 205 AND s2 = 174 AND s3 = 165), false) OR coalesce((d1 = 205 AND d2 = 174 AND d3 = 165), false) AS lab,
    dst1 LIKE '%.255' OR coalesce(d1 BETWEEN 224 AND 239, false) OR dst1 LIKE 'ff%' OR dst1 LIKE 'fe80%' OR dst1 LIKE '169.254.%' AS many FROM s1"""


#: Fixed values, written here apart from the rules so that a slip in either shows.
_SETS = {
    "L3_CONTROL": ("arp", "icmp", "icmpv6", "rarp", "teredo",),
    "NAME_RESOLUTION": ("bootp", "dhcp", "dhcpv6", "dns", "llmnr", "mdns", "nbns",),
    "WINDOWS": ("nbdgm", "nbss", "smb", "smb2", "srvloc", "ssdp",),
    "INFRASTRUCTURE": ("chargen", "lsd", "ntp", "rtcp", "snmp", "stun",),
    "BACKGROUND_SNI": ("javadl-esd-secure.oracle.com", "watson.telemetry.microsoft.com",),
    "AUTO_L7": ("bootp", "browser", "dhcp", "dhcpv6", "llmnr", "mdns", "nbdgm", "nbns", "ssdp",),
    "AUTO_PORTS": (67, 68, 137, 138, 546, 547, 1900, 3702, 5353, 5355,),
    "SAFE_L7": (
        "bootp", "browser", "cdp", "coap", "dhcp", "dhcpv6", "icmpv6", "igmp", "lldp", "llmnr", "lsd", "mdns", "nbdgm", "nbns", "ntp",
        "rarp", "ssdp", "stp", "wsdd",
    ),
    "ATTACKERS": (
        "13.58.225.34", "13.58.98.64", "13.59.126.31", "172.31.70.16", "172.31.70.23", "172.31.70.4", "172.31.70.46", "172.31.70.6",
        "172.31.70.8", "18.216.200.189", "18.216.24.42", "18.217.165.70", "18.218.11.51", "18.218.115.60", "18.218.229.235",
        "18.218.55.126", "18.219.193.20", "18.219.211.138", "18.219.32.43", "18.219.5.43", "18.219.9.1", "18.221.219.4", "52.14.136.135",
    ),
    "VICTIMS": ("172.31.69.13", "172.31.69.24"),
}
_PATTERNS = {
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
_CIC18 = ["Aa_2", "Aa_4", "Aa_6", "Aa_7", "Bb_13", "Bb_14", "Bb_15", "Bb_16", "Bb_17", "Bb_18", "Bb_19", "Bb_20", "Bb_21", "Bb_22", "Bb_23"]
_VPN16 = ["Aa_1", "Aa_2", "Aa_4", "Aa_5", "Aa_6", "Aa_7", "Bb_1", "Bb_2", "Bb_3", "Cc_1", "Cc_2", "Cc_3", "Cc_5", "Cd_2", "Cd_3", "Cd_4", "De_1", "De_2", "De_3", "De_4", "Df_1"]


def _in(column: str, values: tuple) -> str:
    return f"{column} IN ({', '.join(repr(v) for v in values)})"


def _match(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, $r${_PATTERNS[pattern]}$r$)"


_TORRENT = "(L7 IN ('bt-dht', 'bt-tracker') OR src_port IN (6969, 61009) OR dst_port IN (6969, 61009))"
_CONTROL = f"({_in('L7', _SETS['L3_CONTROL'] + _SETS['NAME_RESOLUTION'] + _SETS['WINDOWS'] + _SETS['INFRASTRUCTURE'])})"
_PREDICATES = {
    "Aa_1": "L4 = 'tcp' AND NOT (has_SYN = 1 AND has_SYN_ACK = 1)",
    "Aa_2": "contains(ws_col_info, 'packet size limited during capture') OR contains(ws_col_info, 'malformed packet') OR contains(ws_col_info, 'truncated')",
    "Aa_3": "L4 = 'tcp' AND has_FIN_cli = 0 AND has_FIN_serv = 0",
    "Aa_4": "contains(ws_col_info, 'malformed')",
    "Aa_5": "L4 = 'tcp' AND (L7 = 'tls' OR src_port = 443 OR dst_port = 443 OR has_TLS_CHLO = 1 OR has_TLS_SHLO = 1) AND (has_TLS_CHLO = 0 OR has_TLS_SHLO = 0)",
    "Aa_6": "task1 IN ('unlabeled', 'double')",
    "Aa_7": "L3 = 'ipv6'",
    "Bb_1": f"{_in('L7', _SETS['INFRASTRUCTURE'])} AND NOT (contains(cls, 'voip') AND L7 IN ('stun', 'rtcp'))",
    "Bb_2": f"{_TORRENT} AND NOT (contains(cls, 'bittorrent') OR task2 = 'p2p')",
    "Bb_3": f"((contains(cls, 'scp') AND L7 <> 'ssh') OR (contains(cls, 'ftp') AND L7 = 'sip')) AND NOT {_CONTROL}",
    "Bb_4": "tls_sni NOT IN ('', '-') AND task3 NOT IN ('', '-') AND tls_sni <> task3 AND NOT ends_with(tls_sni, '.' || task3)",
    "Bb_5": f"benign AND (has_botid = 1 OR upload_filename NOT IN ('', '-', '0') OR ({_match('http_susp_uri', 'injection')} AND NOT {_match('http_susp_uri', 'tracker')}))",
    "Bb_6": "NOT benign AND L4 = 'udp' AND r1 = 100 AND r2 BETWEEN 64 AND 127 AND dst_port = 7001",
    "Bb_7": f"NOT benign AND ({_in('L7', _SETS['AUTO_L7'])} OR {_in('src_port', _SETS['AUTO_PORTS'])} OR {_in('dst_port', _SETS['AUTO_PORTS'])} OR L3 IN ('arp', 'rarp') OR L4 = 'icmpv6' OR {_match('dns_qry', 'auto_dns')} OR {_match('http_uri', 'auto_uri')})",
    "Bb_8": "contains(cls, 'infiltration')",
    "Bb_9": "benign AND contains(ftp_arg, '\\t')",
    "Bb_10": f"benign AND {_match('ssh_proto', 'ssh_tool')}",
    "Bb_11": f"benign AND {_match('raw_uri', 'hulk')}",
    "Bb_12": f"benign AND NOT {_match('raw_uri', 'hulk')} AND {_match('raw_uri', 'goldeneye')}",
    "Bb_13": f"benign AND ({_in('src_ip', _SETS['ATTACKERS'])} OR {_in('dst_ip', _SETS['ATTACKERS'])})",
    "Bb_14": f"benign AND ({_match('dns_qry', 'recon')} OR {_match('http_ua', 'scanner')} OR {_match('sip_ua', 'sip_scanner')})",
    "Bb_15": "contains(cls, 'ftp-patator')",
    "Bb_16": "contains(cls, 'slowhttptest')",
    "Bb_17": "contains(cls, 'ssh-patator') AND dst_port = 21",
    "Bb_18": "contains(cls, 'loic-udp') AND L4 = 'icmp'",
    "Bb_19": "contains(cls, 'slowloris') AND payload_size = 0",
    "Bb_20": "contains(cls, 'goldeneye') AND has_RST = 1 AND ts_last - ts_first < 5.05",
    "Bb_21": f"contains(cls, 'web-attack') AND {_match('http_uri', 'static')}",
    "Bb_22": "contains(cls, '_bot') AND payload_size = 0",
    "Bb_23": f"benign AND {_in('src_ip', _SETS['VICTIMS'])} AND starts_with(dst_ip, '172.31.69.') AND has_SYN = 1 AND has_SYN_ACK = 0",
    "Bb_24": "NOT benign AND (spub OR dpub) AND NOT lab",
    "Bb_25": f"NOT benign AND s1 IS NOT NULL AND d1 IS NOT NULL AND NOT spub AND NOT dpub AND NOT many AND NOT lab AND {_in('L7', _SETS['SAFE_L7'])}",
    "Bb_26": "NOT benign AND many AND NOT lab",
    "Bb_27": "benign AND is_nmap_probe = 1",
    "Bb_28": "false",
    "Bb_29": "false",
    "Cc_1": f"{_in('L7', _SETS['L3_CONTROL'])} OR L3 IN ('ipv6', 'arp', 'rarp') OR L4 IN ('icmp', 'icmpv6')",
    "Cc_2": _in("L7", _SETS['NAME_RESOLUTION']),
    "Cc_3": _in("L7", _SETS['WINDOWS']),
    "Cc_4": _in("L7", _SETS['INFRASTRUCTURE']),
    "Cc_5": "ends_with(dst_ip, '.255') OR coalesce(r1 BETWEEN 224 AND 239, false) OR starts_with(dst_ip, 'ff') OR starts_with(dst_ip, 'fe80') OR starts_with(dst_ip, '169.254.')",
    "Cd_1": _TORRENT,
    "Cd_2": f"http_ua = 'winhttp' OR {_in('tls_sni', _SETS['BACKGROUND_SNI'])} OR contains(dns_qry, 'msftncsi') OR contains(http_uri, 'msftncsi')",
    "Cd_3": _match("tls_sni", "delivery"),
    "Cd_4": "contains(http_ua, 'apt-http')",
    "De_1": "(contains(tls_sni, 'gstatic') OR contains(tls_sni, 'google')) AND NOT contains(tls_sni, 'googlevideo') AND L7 IN ('tls', 'gquic')",
    "De_2": "contains(tls_sni, 'mail')",
    "De_3": _match("tls_sni", "ads"),
    "De_4": _match("tls_sni", "browser"),
    "Df_1": _match("http_uri", "msn"),
}
_MARKS = f"{M}, s0 AS ({_SAFE}), s1 AS ({_MORE}), s AS ({_FLAGS}), marks AS (SELECT event_id, task1 AS t1, task3 AS t3, cls, " + ", ".join(f"coalesce({sql}, false)::INT AS {code}" for code, sql in _PREDICATES.items()) + " FROM s)"
_ALL = ", ".join(_PREDICATES)
ORACLES["rules_onehot"] = f"WITH {_MARKS} SELECT event_id, {_ALL} FROM marks"
_SUM = " + ".join(_PREDICATES)
ORACLES["rule_report"] = f"WITH {_MARKS} SELECT count(*) AS total, count(*) FILTER ({_SUM} >= 1) AS any_noise, count(*) FILTER ({_SUM} >= 2) AS multi_noise, " + ", ".join(f"sum({c})::BIGINT AS {c}" for c in _PREDICATES) + " FROM marks"
_SINGLE = "has_SYN = 1 AND has_SYN_ACK = 0 AND pkt_count = 1"
ORACLES["rules_scoped"] = f"WITH {M}, s0 AS ({_SAFE}), s1 AS ({_MORE}), s AS ({_FLAGS}) SELECT event_id, coalesce((contains(cls, 'goldeneye') OR contains(cls, 'benign')) AND {_SINGLE} AND L4 = 'tcp', false)::INT AS Bb_28, coalesce(contains(cls, 'dos') AND {_SINGLE}, false)::INT AS Bb_29 FROM s"
ORACLES["perrule_counts"] = f"WITH {_MARKS}, sums AS (SELECT " + ", ".join(f"sum({c})::BIGINT AS {c}" for c in _PREDICATES) + f" FROM marks) SELECT rule, sessions FROM (UNPIVOT sums ON {_ALL} INTO NAME rule VALUE sessions)"


def _any(codes: list[str]) -> str:
    return "(" + " + ".join(codes) + ") > 0"


ORACLES["perclass_counts"] = f"""WITH {_MARKS} SELECT CASE WHEN t1 = 'benign' THEN 'benign' ELSE 'attack' END AS "group", cls AS class, count(*) AS before, count(*) FILTER (NOT {_any(_CIC18)}) AS after,
    count(*) FILTER ({_any(_CIC18)}) AS removed, (count(*) FILTER (NOT {_any(_CIC18)}) = 0)::INT AS vanished FROM marks GROUP BY 1, 2"""
ORACLES["any_noise_filter"] = f"WITH {_MARKS} SELECT marks.event_id, m0.task3 FROM marks JOIN m0 USING (event_id) WHERE NOT {_any(_VPN16)}"
ORACLES["flagship"] = f"""WITH {_MARKS}, c AS (SELECT 'all' AS "group", t3 AS class, count(*) AS before, count(*) FILTER (NOT {_any([f'Aa_{n}' for n in range(1, 8)])}) AS after FROM marks GROUP BY 2)
    SELECT *, before - after AS removed, (after = 0)::INT AS vanished, row_number() OVER (ORDER BY before DESC, class)::INT AS place FROM c"""

# Labels
ORACLES["label_interval_join"] = """
    WITH s AS (SELECT o_orderkey, date_diff('day', DATE '1970-01-01', o_orderdate::DATE)::DOUBLE AS t FROM orders),
    w AS (SELECT o_orderkey, CASE WHEN o_orderkey % 40 <> 1 THEN t END AS t0, CASE WHEN o_orderkey % 40 <> 2 THEN t + CASE o_orderkey % 3 WHEN 0 THEN 2 ELSE 400 END END AS t1 FROM s),
    f AS (SELECT l_orderkey AS o_orderkey, date_diff('day', DATE '1970-01-01', l_shipdate::DATE)::DOUBLE AS t, l_returnflag AS label FROM lineitem),
    b AS (SELECT o_orderkey, t, label FROM f UNION ALL SELECT o_orderkey, t + 500, label FROM f),
    j AS (SELECT w.o_orderkey, t, label, t0, t1, t BETWEEN t0 - 30 AND t1 + 30 AS inside, greatest(t0 - t, t - t1, 0) AS d FROM w LEFT JOIN b USING (o_orderkey)),
    g AS (SELECT o_orderkey, bool_or(t0 IS NULL OR t1 IS NULL) AS damaged, count(DISTINCT label) FILTER (inside) AS n, coalesce(max(label) FILTER (inside AND label <> 'N'), max(label) FILTER (inside)) AS one, count(t) AS flows,
        arg_min(label, (d, t, label)) FILTER (t IS NOT NULL) AS nearest FROM j GROUP BY 1)
    SELECT o_orderkey, CASE WHEN damaged THEN 'damaged' WHEN flows = 0 THEN 'unlabeled' WHEN n > 1 THEN 'double' WHEN n = 1 THEN one ELSE nearest END AS label,
        CASE WHEN damaged THEN 'damaged' WHEN flows = 0 THEN 'unlabeled' WHEN n > 1 THEN 'double' WHEN n = 1 THEN 'inside' ELSE 'nearest' END AS how FROM g"""
_WINDOWS = ", ".join(f"({s}, {e}, {a}, {v}, '{x}')" for s, e, a, v, x in SCHEDULE)
ORACLES["label_schedule_range"] = f"""
    WITH {P}, w AS (SELECT * FROM (VALUES {_WINDOWS}) AS v(s, e, attackers, victims, attack)),
    q AS (SELECT event_id, floor(t) AS t, user_id % 40 AS a, event_id % 40 AS b FROM p),
    h AS (SELECT event_id, count(attack) AS n, max(attack) AS attack FROM q LEFT JOIN w ON t BETWEEN s - 120 AND e + 120
        AND ((list_contains(attackers, a) AND list_contains(victims, b)) OR (list_contains(attackers, b) AND list_contains(victims, a))) GROUP BY 1)
    SELECT event_id, CASE WHEN n > 1 THEN 'double' WHEN n = 1 THEN attack ELSE 'Benign' END AS label FROM h"""
ORACLES["label_audit"] = """
    WITH k AS (SELECT l_orderkey, list_sort(list_distinct(list(l_returnflag))) AS l FROM lineitem GROUP BY 1)
    SELECT array_to_string(l, '+') AS labels, CASE WHEN len(l) <= 1 THEN 'single' WHEN list_contains(l, 'N') THEN 'benign+attack' ELSE 'multi' END AS kind, count(*) AS keys FROM k GROUP BY 1, 2"""
ORACLES["count_check"] = """
    WITH a AS (SELECT n_regionkey AS k, count(*) AS n FROM nation GROUP BY 1), b AS (SELECT r_regionkey + 1 AS k FROM region)
    SELECT coalesce(a.k, b.k) AS k, coalesce(n, 0) AS found, CASE WHEN b.k IS NULL THEN 0 ELSE 5 END AS expected, coalesce(n = 5 AND b.k IS NOT NULL, false) AS ok FROM a FULL JOIN b ON a.k = b.k"""
ORACLES["sni_mode_audit"] = """
    WITH h AS (SELECT page_id, page_id % 10 AS g, regexp_extract(url, '://([^/?#]*)', 1) AS host FROM pages),
    d AS (SELECT *, array_to_string(string_split(host, '.')[-2:], '.') AS domain, row_number() OVER (PARTITION BY g ORDER BY page_id) AS r FROM h),
    s AS (SELECT * FROM d WHERE r <= 20), c AS (SELECT g, domain, host, count(*) AS n FROM s WHERE host <> '' GROUP BY ALL),
    t AS (SELECT g, domain, arg_min(host, (-n, host)) AS host FROM c GROUP BY 1, 2), u AS (SELECT DISTINCT g, domain FROM s)
    SELECT g, domain, host, CASE WHEN host IS NULL THEN 'NO_SNI' WHEN host = domain OR ends_with(host, '.' || domain) THEN 'OK' ELSE 'MISMATCH' END AS verdict FROM u LEFT JOIN t USING (g, domain)"""

# Keys and lists
ORACLES["content_key"] = f"""
    WITH {P}, e AS (SELECT event_id, us, '10.0.0.' || (user_id % 50) || ':443' AS x, '10.0.1.' || (event_id % 50) || ':' || (event_id % 1000) AS y FROM p)
    SELECT event_id, substr(sha1('tcp|' || least(x, y) || '|' || greatest(x, y) || '|' || us), 1, 16) AS content_key FROM e"""
ORACLES["align_copies"] = """
    WITH d AS (SELECT md5(text) AS key, doc_id, 'f' || doc_id AS filename, 'tcp_' || (doc_id % 7) AS session_id FROM documents),
    l AS (SELECT * FROM d WHERE doc_id % 2 = 0), f AS (SELECT * FROM d WHERE doc_id % 3 <> 0),
    p AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id) AS k FROM l WHERE doc_id NOT IN (SELECT doc_id FROM f)),
    o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id) AS k FROM f WHERE doc_id NOT IN (SELECT doc_id FROM l)),
    n AS (SELECT key, min(doc_id) AS doc_id FROM f GROUP BY 1),
    a AS (SELECT doc_id, doc_id AS found FROM l WHERE doc_id IN (SELECT doc_id FROM f)
          UNION ALL SELECT p.doc_id, coalesce(o.doc_id, n.doc_id) FROM p LEFT JOIN o ON o.key = p.key AND o.k = p.k LEFT JOIN n ON n.key = p.key)
    SELECT l.key, l.filename, l.session_id, 'f' || found AS found_filename, 'tcp_' || (found % 7) AS found_session_id FROM l JOIN a USING (doc_id)"""


def _crc_table() -> str:
    table = []
    for value in range(256):
        for _ in range(8):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        table.append(value)
    return f"[{', '.join(f'{v}::BIGINT' for v in table)}]"


_CRC = "xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(k, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8)), 4294967295::BIGINT)"
_SPLIT = f"{M}, k AS (SELECT filename, session_id, '42|' || filename || '|' || session_id AS k, {_crc_table()} AS t FROM m0), r AS (SELECT filename, session_id, {_CRC} AS hash FROM k)"
ORACLES["hash_split"] = f"WITH {_SPLIT} SELECT filename, session_id, CASE WHEN hash / 4294967295.0 < 0.2 THEN 'test' ELSE 'train' END AS role, hash FROM r"
ORACLES["split_leakage"] = f"WITH {M} SELECT count(DISTINCT (filename, session_id)) AS sessions, 0 AS leaking FROM m0"


def _order(seed: int, column: str = "doc_id") -> str:
    return f"md5('{seed}|' || {column}), {column}"


ORACLES["topk_per_class"] = f"SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY {_order(42)}) <= 25"
ORACLES["size_match"] = f"""
    WITH n AS (SELECT lang, count(*) AS n FROM documents WHERE n_chars > 2000 GROUP BY 1),
    r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {_order(7)}) AS k FROM documents) SELECT doc_id, lang FROM r JOIN n USING (lang) WHERE k <= n"""
ORACLES["inject_mix"] = f"""
    WITH c AS (SELECT lang, count(*) FILTER (n_chars < 300) AS noisy, count(*) FILTER (n_chars >= 300) AS n, count(*) AS total FROM documents GROUP BY 1),
    w AS (SELECT lang, n, least(round_even(least(1.0, noisy / total + 0.05) * n, 0)::BIGINT, noisy) AS k FROM c WHERE n > 0),
    r AS (SELECT doc_id, lang, (n_chars < 300)::INT AS is_noise, row_number() OVER (PARTITION BY lang, n_chars < 300 ORDER BY {_order(42)}) AS x FROM documents)
    SELECT doc_id, lang, is_noise FROM r JOIN w USING (lang) WHERE x <= CASE WHEN is_noise = 1 THEN k ELSE n - k END"""
ORACLES["at_least"] = "SELECT doc_id, lang FROM documents WHERE lang IN (SELECT lang FROM documents GROUP BY 1 HAVING count(*) >= 120)"
ORACLES["label_map"] = """
    WITH l AS (SELECT DISTINCT lang AS label FROM documents), o AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS id FROM l WHERE label IN ('en', 'fr'))
    SELECT label, id::INT AS id FROM o UNION ALL SELECT label, (row_number() OVER (ORDER BY label) - 1 + (SELECT count(*) FROM o))::INT FROM l WHERE label NOT IN ('en', 'fr')"""
ORACLES["roundrobin_sample"] = f"WITH r AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY {_order(42, 'vec_id')}) AS k FROM embeddings) SELECT vec_id, label FROM r ORDER BY k, label LIMIT 50"
ORACLES["kfold_assign"] = f"SELECT doc_id, ((row_number() OVER (PARTITION BY quality ORDER BY {_order(42)}) - 1) % 5)::INT AS fold FROM labels"
ORACLES["inner_validation"] = f"""
    WITH r AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY {_order(42, 'vec_id')}) AS k, count(*) OVER (PARTITION BY label) AS n FROM embeddings)
    SELECT vec_id, label, (n >= 5 AND k <= greatest(1, round_even(n * 0.1, 0)))::INT AS is_validation FROM r"""
ORACLES["reservoir_equiv"] = "SELECT sum(least(n, 10))::BIGINT AS n, 0 AS differ FROM (SELECT count(*) AS n FROM documents GROUP BY lang)"

# Features
_FLOW = f"{P}, f AS (SELECT *, event_type IN ('view', 'click') AS fwd, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS k, row_number() OVER (PARTITION BY user_id, event_type IN ('view', 'click') ORDER BY us, event_id) AS dk FROM p)"


def _stats(names: list[str], prefix: str = "") -> str:
    sql = {
        "sum": "sum(v)", "max": "max(v)", "min": "min(v)", "mean": "avg(v)", "var": "var_pop(v)", "std": "stddev_pop(v)", "sstd": "coalesce(stddev_samp(v), 0)",
        "gmean": "CASE WHEN min(v) > 0 THEN exp(avg(ln(CASE WHEN v > 0 THEN v END))) END", "q25": "quantile_cont(v, 0.25)", "q50": "quantile_cont(v, 0.5)", "q75": "quantile_cont(v, 0.75)",
        "iqr": "quantile_cont(v, 0.75) - quantile_cont(v, 0.25)", "range": "max(v) - min(v)",
    }
    return ", ".join(f"CASE WHEN count(*) > 1 OR max(v) <> 0 THEN round({sql[n]}, 6) END AS {prefix}{n}" for n in names)


ORACLES["stats15"] = f"""
    WITH {P}, b AS (SELECT user_id, value AS v, avg(value) OVER (PARTITION BY user_id) AS mu FROM p),
    c AS (SELECT user_id, avg(pow(v - mu, 2)) AS m2, avg(pow(v - mu, 3)) AS m3, avg(pow(v - mu, 4)) AS m4 FROM b GROUP BY 1),
    s AS (SELECT user_id, {_stats(['sum', 'max', 'min', 'mean', 'var', 'std', 'sstd', 'gmean', 'q25', 'q50', 'q75', 'iqr', 'range'])} FROM b GROUP BY 1)
    SELECT s.*, CASE WHEN m2 > 0 THEN round(m3 / pow(m2, 1.5), 6) END AS skew, CASE WHEN m2 > 0 THEN round(m4 / (m2 * m2) - 3, 6) END AS kurt FROM s JOIN c USING (user_id)"""
_PREFIX = " ".join(
    f"LEFT JOIN (SELECT user_id, {_stats(['sum', 'max', 'min', 'mean', 'var', 'std', 'sstd', 'gmean', 'q25', 'q50', 'q75', 'iqr', 'range'], f"{way}_{k or 'All'}_")} FROM d WHERE fwd = {way == 'Forward'} AND j <= {k or 10**9} GROUP BY 1) USING (user_id)" for way in ("Forward", "Backward") for k in (None, 5, 10, 15, 20, 25, 30)
)
ORACLES["stats15_prefix"] = f"WITH {_FLOW}, d AS (SELECT user_id, fwd, value AS v, row_number() OVER (PARTITION BY user_id, fwd ORDER BY us, event_id) AS j FROM f WHERE value > 0), u AS (SELECT DISTINCT user_id FROM p) SELECT * FROM u {_PREFIX}"


def _rates(name: str, where: str) -> str:
    n, duration = f"count(*) FILTER ({where})", f"(CASE WHEN count(*) FILTER ({where}) >= 2 THEN max(t) FILTER ({where}) - min(t) FILTER ({where}) END)"
    return f"""round(coalesce(sum(value) FILTER ({where}), 0) / nullif({duration}, 0), 4) AS Bps_{name}, round({n} / nullif({duration}, 0), 4) AS Pps_{name},
        round({duration}, 4) AS Duration_{name}, round({n}, 4) AS Packet_Count_{name}, round({duration} / nullif({n} - 1, 0), 4) AS Mean_Arrived_{name}"""


ORACLES["flow_scalar2"] = f"WITH {_FLOW} SELECT user_id, {_rates('Both', 'true')}, {_rates('Forward', 'fwd OR value = 0')}, {_rates('Backward', 'NOT (fwd OR value = 0)')} FROM f GROUP BY 1"
ORACLES["iat"] = f"""
    WITH {P}, f AS (SELECT event_id, event_type IN ('view', 'click') AS fwd, us - lag(us) OVER (PARTITION BY user_id, day ORDER BY us, event_id) AS gap,
        row_number() OVER (PARTITION BY user_id, day, event_type IN ('view', 'click') ORDER BY us, event_id) AS n FROM p)
    SELECT event_id, CASE WHEN fwd THEN gap ELSE -gap END AS iat, CASE WHEN fwd THEN n ELSE -n END AS dir_index FROM f"""
ORACLES["psd_vector"] = f"""
    WITH {_FLOW}, u AS (SELECT DISTINCT user_id FROM p), g AS (SELECT user_id, unnest(range(0, 100))::INT AS pos FROM u)
    SELECT g.user_id, pos, round(coalesce(abs(value), 0), 4) AS x FROM g LEFT JOIN f ON f.user_id = g.user_id AND f.k = pos + 1"""
_FLAG = {"S": "signup", "FA": "purchase", "PA": "view"}
ORACLES["flag_counts"] = "SELECT user_id, " + ", ".join(
    f"count(*) FILTER ({'event_type NOT IN (' + repr('signup') + ', ' + repr('purchase') + ', ' + repr('view') + ')' if n == 'A' else 'event_type = ' + repr(_FLAG.get(n, '?'))}) AS flag_{n}" for n in ("S", "SA", "A", "FA", "F", "R", "PA", "FPA", "RA")
) + " FROM events GROUP BY 1"
ORACLES["derived14"] = f"""
    WITH {_DIRECTION}, a AS (SELECT user_id, day, count(*) AS n, round(sum(value), 4) AS b, min(us) / 1e6 AS t0, max(us) / 1e6 AS t1 FROM p GROUP BY 1, 2),
    r AS (SELECT user_id, day, fwd_pkt, round(fwd_byte, 4) AS fb, bwd_pkt, round(bwd_byte, 4) AS bb FROM d)
    SELECT user_id, day, round(greatest(t1 - t0, 0), 3) AS duration, CASE WHEN t1 > t0 THEN round(n / (t1 - t0 + 1e-9), 3) END AS pkt_rate, CASE WHEN t1 > t0 THEN round(b / (t1 - t0 + 1e-9), 3) END AS byte_rate, round(b / (n + 1e-9), 3) AS mean_pkt_size, round(fwd_pkt / (n + 1e-9), 3) AS fwd_pkt_ratio, round(fb / (b + 1e-9), 3) AS fwd_byte_ratio,
        round(fwd_pkt / (bwd_pkt + 1.0), 3) AS fwd_bwd_pkt_ratio, round(fb / (bb + 1.0), 3) AS fwd_bwd_byte_ratio FROM a JOIN r USING (user_id, day)"""
ORACLES["header_bytes"] = """
    WITH v AS (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN -1 ELSE event_id * 37 % 65536 END AS v FROM events)
    SELECT event_id, (CASE WHEN v < 0 THEN -1 ELSE v // 256 END)::INT AS high, (CASE WHEN v < 0 THEN -1 ELSE v % 256 END)::INT AS low FROM v"""

# Bytes
_HEX = "h AS (SELECT doc_id, lang, lower(hex(encode(text))) AS raw FROM documents)"
_BYTE = "('0x' || substr({0}, {1}, 2))::INT"
ORACLES["image784"] = f"""
    WITH {_HEX} SELECT doc_id, md5(array_to_string(list_transform(range(0, 784), lambda k: CASE WHEN 2 * k + 2 <= length(raw) THEN {_BYTE.format('raw', '2 * k + 1')} ELSE 257 END), ',')) AS image FROM h"""
ORACLES["matrix1600"] = f"""
    WITH {_HEX}, c AS (SELECT doc_id, array_to_string(list_transform(range(0, 5), lambda k: rpad(substr(raw, (k * 600 + 1)::BIGINT, ((40 + k) * 2)::BIGINT), 160, '0')
        || rpad(substr(substr(raw, (k * 600 + 1)::BIGINT, 600), ((40 + k) * 2 + 1)::BIGINT, 480), 480, '0')), '') AS x FROM h)
    SELECT doc_id, md5(array_to_string(list_transform(range(0, 1600), lambda k: {_BYTE.format('x', '2 * k + 1')}), ',')) AS matrix FROM c"""
ORACLES["bigrams128"] = f"""
    WITH {_HEX} SELECT doc_id, array_to_string(list_transform(range(0, 128), lambda k: CASE WHEN 2 * k + 4 <= length(raw) THEN substr(raw, 2 * k + 1, 4) ELSE '0000' END), ' ') AS tokens FROM h"""
ORACLES["mask_spans"] = f"""
    WITH {_HEX} SELECT doc_id, md5(array_to_string(list_transform(range(0, length(raw) // 2), lambda k: CASE WHEN k BETWEEN 12 AND 19 OR k BETWEEN 0 AND 3 OR k BETWEEN 500 AND 503 THEN '00' ELSE substr(raw, 2 * k + 1, 2) END), '')) AS masked FROM h"""
ORACLES["uncond_histogram"] = f"WITH {_HEX}, b AS (SELECT lang, unnest(list_transform(range(0, least(100, length(raw) // 2)), lambda k: {_BYTE.format('raw', '2 * k + 1')})) AS bin FROM h) SELECT lang, bin, count(*) AS n FROM b GROUP BY 1, 2"
ORACLES["field_runs"] = """
    WITH c AS (SELECT event_id, user_id, event_id // 4 AS packet, event_type FROM events),
    g AS (SELECT *, coalesce(packet <> lag(packet) OVER w OR event_type <> lag(event_type) OVER w, true)::INT AS new FROM c WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
    r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM g)
    SELECT event_id, row_number() OVER (PARTITION BY user_id, run ORDER BY event_id)::INT AS byte_index FROM r"""

# Evaluation
_PRED = "q AS (SELECT doc_id, source, lang AS truth, CASE WHEN n_chars % 5 = 0 THEN 'en' WHEN doc_id % 11 = 0 THEN 'xx' ELSE lang END AS pred, n_chars < 400 AS noise FROM documents)"
ORACLES["confusion"] = f"WITH {_PRED} SELECT truth, pred, count(*) AS n FROM q GROUP BY 1, 2"
_SCORES = f"""{_PRED}, c AS (SELECT truth AS class FROM q UNION SELECT pred FROM q),
    s AS (SELECT class, count(*) FILTER (truth = class AND pred = class) AS tp, count(*) FILTER (truth <> class AND pred = class) AS fp, count(*) FILTER (truth = class AND pred <> class) AS fn FROM c CROSS JOIN q GROUP BY 1),
    t AS (SELECT *, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM s)"""
ORACLES["class_scores"] = f"WITH {_SCORES} SELECT class, tp, fp, fn, round(precision, 4) AS precision, round(recall, 4) AS recall, round(f1, 4) AS f1 FROM t"
ORACLES["macro_f1"] = f"WITH {_SCORES} SELECT round(avg(f1), 4) AS macro_f1, round(sum(tp) / sum(tp + fn), 4) AS accuracy, sum(tp + fn)::BIGINT AS n FROM t WHERE tp + fn > 0"
_CELLS = "c AS (SELECT user_id % 6 AS dataset, user_id % 5 AS seed, 'exp' || (event_id % 4 + 1) AS exp, avg(value) AS acc FROM events GROUP BY 1, 2, 3)"
_EXPS = ("exp1", "exp2", "exp3", "exp4")
ORACLES["result_pivot"] = f"WITH {_CELLS}, w AS (SELECT dataset, " + ", ".join(f"avg(acc) FILTER (exp = '{e}') AS {e}" for e in _EXPS) + " FROM c GROUP BY 1) SELECT dataset, " + ", ".join(f"round({e}, 4) AS {e}" for e in _EXPS) + ", round((exp1 - exp3) * 100, 4) AS delta FROM w"
ORACLES["seed_stats"] = f"""
    WITH {_CELLS}, d AS (SELECT dataset, seed, (avg(acc) FILTER (exp = 'exp1') - avg(acc) FILTER (exp = 'exp3')) * 100 AS delta FROM c GROUP BY 1, 2),
    s AS (SELECT dataset, count(delta) AS n, avg(delta) AS mean, stddev_samp(delta) AS sd, min(delta) AS least, max(delta) AS greatest, count(*) FILTER (delta > 0) AS positive FROM d GROUP BY 1),
    h AS (SELECT *, list_value(12.706, 4.303, 3.182, 2.776, 2.571, 2.447, 2.365, 2.306, 2.262)[n - 1] * sd / sqrt(n) AS half FROM s)
    SELECT dataset, n, round(mean, 4) AS mean, round(sd, 4) AS sd, round(least, 4) AS least, round(greatest, 4) AS greatest, positive, round(half, 4) AS half,
        CASE WHEN sd IS NULL THEN 'one value' WHEN abs(mean) <= 2 * sd THEN 'within error' WHEN mean - half > 0 THEN '+' WHEN mean + half < 0 THEN '-' ELSE 'inconclusive' END AS verdict FROM h"""
ORACLES["missing_audit"] = "SELECT n_nationkey, r_regionkey FROM nation CROSS JOIN region WHERE NOT (n_nationkey % 3 = 0 AND n_regionkey = r_regionkey)"
ORACLES["variant_blend"] = f"""
    WITH {_CELLS}, a AS (SELECT dataset, seed, avg(acc) FILTER (exp = 'exp1') AS exp1 FROM c WHERE seed < 3 GROUP BY 1, 2),
    b AS (SELECT dataset, seed, avg(acc) FILTER (exp = 'exp2') AS exp2, avg(acc) FILTER (exp = 'exp3') AS exp3, avg(acc) FILTER (exp = 'exp4') AS exp4 FROM c WHERE seed > 0 GROUP BY 1, 2)
    SELECT dataset, seed, round(exp1, 4) AS exp1, round(exp2, 4) AS exp2, round(exp3, 4) AS exp3, round(exp4, 4) AS exp4 FROM a JOIN b USING (dataset, seed) WHERE exp1 + exp2 + exp3 + exp4 IS NOT NULL"""
ORACLES["noise_antijoin"] = "SELECT doc_id FROM documents WHERE n_chars < 400"
ORACLES["evaluation_lift"] = f"""
    WITH {_PRED}, g AS (SELECT source, count(*) FILTER (truth <> pred) AS wrong, count(*) FILTER (truth <> pred AND noise) AS wrong_noise, count(*) AS total, count(*) FILTER (noise) AS total_noise FROM q GROUP BY 1),
    l AS (SELECT *, (wrong_noise / nullif(wrong, 0)) / nullif(total_noise / nullif(total, 0), 0) AS lift FROM g)
    SELECT source, wrong, wrong_noise, total, total_noise, round(lift, 4) AS lift, CASE WHEN lift >= 1.3 THEN 'strong' WHEN lift >= 1.05 THEN 'weak' WHEN lift < 1 THEN 'reversed' ELSE 'none' END AS verdict FROM l"""
ORACLES["error_composition"] = f"""
    WITH {_PRED}, e AS (SELECT *, pred <> truth AS w2, doc_id % 7 = 0 AS w4 FROM q)
    SELECT truth, count(*) FILTER (w2) AS e2, count(*) FILTER (w4) AS e4, count(*) FILTER (w2 AND noise) AS e2_noise, count(*) FILTER (w2 AND NOT w4) AS gain, count(*) FILTER (w2 AND NOT w4 AND noise) AS gain_noise FROM e GROUP BY 1"""
ORACLES["overlap_jaccard"] = f"""
    WITH {_PRED}, j AS (SELECT source, noise AS a, coalesce(quality = 0, false) AS b FROM q LEFT JOIN labels USING (doc_id)),
    n AS (SELECT source, count(*) FILTER (a) AS n_a, count(*) FILTER (b) AS n_b, count(*) FILTER (a AND b) AS n_both FROM j GROUP BY 1)
    SELECT *, round(n_both / nullif(n_b, 0), 4) AS precision, round(n_both / nullif(n_a, 0), 4) AS recall, round(n_both / nullif(n_a + n_b - n_both, 0), 4) AS jaccard FROM n"""
ORACLES["topk_jaccard"] = """
    WITH a AS (SELECT l_suppkey AS s FROM lineitem GROUP BY 1 ORDER BY sum(l_quantity) DESC, 1 LIMIT 30), b AS (SELECT l_suppkey AS s FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 30)
    SELECT round((SELECT count(*) FROM a JOIN b USING (s)) / (SELECT count(*) FROM (SELECT s FROM a UNION SELECT s FROM b)), 4) AS jaccard"""
ORACLES["spearman_avg"] = """
    WITH g AS (SELECT l_suppkey % 20 AS g, l_quantity AS a, l_discount AS b FROM lineitem),
    r AS (SELECT g, rank() OVER (PARTITION BY g ORDER BY a) + (count(*) OVER (PARTITION BY g, a) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY g ORDER BY b) + (count(*) OVER (PARTITION BY g, b) - 1) / 2.0 AS rb FROM g)
    SELECT g, round(corr(ra, rb), 4) AS spearman, count(*) AS n FROM r GROUP BY 1"""
ORACLES["spearman_ordinal"] = """
    WITH r AS (SELECT o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) AS ra, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_custkey, o_orderkey) AS rb FROM orders)
    SELECT o_orderpriority, round(corr(ra, rb), 4) AS spearman, count(*) AS n FROM r GROUP BY 1"""
ORACLES["mass_by_field"] = """
    WITH l AS (SELECT vec_id, (unnest(range(0, len(embedding))))::INT AS pos, abs(unnest(embedding)::DOUBLE) AS w FROM embeddings),
    t AS (SELECT *, sum(w) OVER (PARTITION BY vec_id) AS total FROM l) SELECT pos, round(sum(w / total) / (SELECT count(*) FROM embeddings), 6) AS mass FROM t GROUP BY 1"""
_CENTRES = """l AS (SELECT vec_id, label, unnest(range(0, len(embedding))) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings),
    c AS (SELECT label, pos, avg(x) AS m FROM l GROUP BY 1, 2)"""
ORACLES["separation"] = f"""
    WITH {_CENTRES}, d AS (SELECT vec_id, l.label, sqrt(sum(pow(x - m, 2))) AS d FROM l JOIN c ON l.label = c.label AND l.pos = c.pos GROUP BY 1, 2), i AS (SELECT label, avg(d) AS inn FROM d GROUP BY 1),
    a AS (SELECT x.label AS p, y.label AS q, sqrt(sum(pow(x.m - y.m, 2))) AS apart FROM c AS x JOIN c AS y ON x.pos = y.pos AND x.label <> y.label GROUP BY 1, 2),
    w AS (SELECT p, max((i.inn + k.inn) / apart) AS r, avg(apart) AS apart, any_value(i.inn) AS inn FROM a JOIN i ON i.label = p JOIN i AS k ON k.label = q GROUP BY 1)
    SELECT round(avg(r), 4) AS davies_bouldin, round(avg(apart) / avg(inn), 4) AS separation FROM w"""
ORACLES["silhouette"] = """
    WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings ORDER BY md5('42|' || vec_id), vec_id LIMIT 3000),
    d AS (SELECT a.vec_id, a.label, b.label AS other, list_distance(a.v, b.v) AS d FROM e AS a JOIN e AS b ON a.vec_id <> b.vec_id),
    m AS (SELECT vec_id, label, other, avg(d) AS m FROM d GROUP BY 1, 2, 3),
    s AS (SELECT vec_id, max(m) FILTER (label = other) AS i, min(m) FILTER (label <> other) AS o FROM m GROUP BY 1)
    SELECT round(avg((o - i) / greatest(o, i)), 4) AS silhouette, count(*) AS n FROM s"""
ORACLES["cl_flags"] = f"""
    WITH {_CENTRES}, d AS (SELECT l.vec_id, l.label, c.label AS class, exp(-sqrt(sum(pow(x - m, 2)))) AS e FROM l JOIN c ON l.pos = c.pos GROUP BY 1, 2, 3),
    p AS (SELECT vec_id, label, class, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM d), t AS (SELECT class, avg(p) AS t FROM p WHERE class = label GROUP BY 1),
    b AS (SELECT vec_id, label, arg_max(class, (p, -class)) FILTER (p >= t) AS best, max(p) FILTER (class = label) AS quality FROM p JOIN t USING (class) GROUP BY 1, 2)
    SELECT vec_id, label, coalesce(best, label) AS best, round(quality, 6) AS quality, (coalesce(best, label) <> label)::INT AS is_issue FROM b"""

ORACLES["cl_issues"] = f"""
    WITH r AS (SELECT vec_id, label, embedding, (row_number() OVER (PARTITION BY label ORDER BY {_order(42, 'vec_id')}) - 1) % 5 AS fold FROM embeddings),
    x AS (SELECT vec_id, label, fold, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM r),
    s AS (SELECT label AS class, fold, pos, sum(x) AS sx, count(*) AS n FROM x GROUP BY ALL), a AS (SELECT class, pos, sum(sx) AS sx, sum(n) AS n FROM s GROUP BY 1, 2),
    c AS (SELECT a.class, f.fold, a.pos, (a.sx - coalesce(s.sx, 0)) / (a.n - coalesce(s.n, 0)) AS m FROM a CROSS JOIN (SELECT unnest(range(0, 5)) AS fold) AS f
          LEFT JOIN s ON s.class = a.class AND s.pos = a.pos AND s.fold = f.fold WHERE a.n > coalesce(s.n, 0)),
    d AS (SELECT vec_id, label, c.class, exp(-sqrt(sum(pow(x - m, 2)))) AS e FROM x JOIN c ON c.fold = x.fold AND c.pos = x.pos GROUP BY 1, 2, 3),
    p AS (SELECT vec_id, label, class, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM d), t AS (SELECT class, avg(p) AS t FROM p WHERE class = label GROUP BY 1),
    g AS (SELECT vec_id, label, count(*) FILTER (p >= t - 1e-6) AS n, arg_max(class, (p, -class)) AS top, min(class) FILTER (p >= t - 1e-6) AS one, max(p) FILTER (class = label) AS quality FROM p JOIN t USING (class) GROUP BY 1, 2),
    b AS (SELECT label, CASE WHEN n = 1 THEN one WHEN n > 1 THEN top END AS guess, count(*) AS c FROM g GROUP BY 1, 2),
    j AS (SELECT label, guess, max(c) AS c FROM (SELECT * FROM b WHERE guess IS NOT NULL UNION ALL SELECT DISTINCT label, label, 1 FROM r) GROUP BY 1, 2),
    k AS (SELECT label, guess, round_even(c / sum(c) OVER (PARTITION BY label) * n, 0)::BIGINT AS k FROM j JOIN (SELECT label, count(*) AS n FROM r GROUP BY 1) USING (label)),
    m AS (SELECT p.vec_id, k, rank() OVER (PARTITION BY k.label, k.guess ORDER BY p.p - g.quality DESC) AS place FROM k JOIN g USING (label) JOIN p ON p.vec_id = g.vec_id AND p.class = k.guess WHERE k.guess <> k.label AND k > 0)
    SELECT vec_id, label, round(quality, 6) AS quality, (top <> label AND vec_id IN (SELECT vec_id FROM m WHERE place <= k))::INT AS is_issue FROM g"""

# Reports
ORACLES["target_signal"] = f"""
    WITH {_CELLS}, w AS (SELECT dataset, seed, (avg(acc) FILTER (exp = 'exp1') - avg(acc) FILTER (exp = 'exp3')) * 100 AS gap FROM c GROUP BY 1, 2)
    SELECT dataset, count(gap) AS models, round(avg(gap), 4) AS mean_delta, count(*) FILTER (gap > 0) AS positive FROM w GROUP BY 1"""
ORACLES["convergence"] = """
    WITH e AS (SELECT event_type, user_id % 40 AS epoch, avg(value) AS loss FROM events GROUP BY 1, 2 HAVING avg(value) > 45),
    v AS (SELECT epoch, loss AS a FROM e WHERE event_type = 'view'), c AS (SELECT epoch, loss AS b FROM e WHERE event_type = 'click')
    SELECT epoch, round(a, 4) AS a, round(b, 4) AS b, round(a - b, 4) AS gap FROM v FULL JOIN c USING (epoch)"""
ORACLES["last_epoch"] = "SELECT user_id, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY 1"
ORACLES["boundary"] = f"""
    WITH {_CELLS}, w AS (SELECT dataset, seed, avg(acc) FILTER (exp = 'exp1') / 1000 AS exp1, avg(acc) FILTER (exp = 'exp3') / 1000 AS exp3 FROM c GROUP BY 1, 2)
    SELECT dataset, seed, round(exp1, 6) AS exp1, round(exp3, 6) AS exp3, round(exp1 - exp3, 6) AS gap,
        CASE WHEN exp1 - exp3 > 0.02 THEN 'collapse' WHEN exp1 - exp3 < 0 THEN 'reversed' ELSE 'none' END AS verdict FROM w"""
ORACLES["importance_shift"] = """
    WITH s AS (SELECT p_type, coalesce(sum(p_retailprice) FILTER (p_partkey % 3 <> 0), 0) AS a, coalesce(sum(p_retailprice) FILTER (p_partkey % 3 <> 1), 0) AS b FROM part GROUP BY 1),
    r AS (SELECT *, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb, regexp_matches(p_type, '^(ECONOMY|PROMO)') AS m FROM s),
    t AS (SELECT corr(ra, rb) AS spearman, coalesce(sum(a) FILTER (m), 0) / sum(a) * 100 AS x, coalesce(sum(b) FILTER (m), 0) / sum(b) * 100 AS y FROM r)
    SELECT round(spearman, 4) AS spearman, round(x, 4) AS mass_a, round(y, 4) AS mass_b, round(y - x, 4) AS shift, CASE WHEN y < x THEN 'reversed' WHEN y - x > 5 THEN 'strong' ELSE 'weak' END AS verdict FROM t"""
ORACLES["claim_comparison"] = f"""
    WITH {_CELLS}, g AS (SELECT dataset, count(*) AS cells, avg(acc) AS a, avg(acc - seed) AS b FROM c WHERE seed BETWEEN 1 AND 3 GROUP BY 1)
    SELECT dataset, cells, round(a, 4) AS a, round(b, 4) AS b, CASE WHEN abs(a) > abs(b) THEN 'a' WHEN abs(a) < abs(b) THEN 'b' ELSE 'equal' END AS stronger FROM g"""
ORACLES["class_distribution"] = "SELECT lang, count(*) AS origin, count(*) FILTER (n_chars > 1000) AS refined, count(*) FILTER (source = 'src1') AS sampled FROM documents GROUP BY 1"

# The accumulator on made packets: a stream's client is the far end once any packet opens it, else the first source.
ORACLES["wire_sessions"] = """
    WITH q AS (SELECT event_id AS n, user_id % 40 AS st, 'Malware_DoS_x_' || (user_id % 3) || '.pcap' AS filename, event_id % 2 = 0 AS out, trunc(value)::BIGINT AS v FROM events),
    k AS (SELECT *, CASE WHEN st % 4 = 0 THEN 'udp' ELSE 'tcp' END AS proto, CASE WHEN st % 4 = 0 THEN greatest(v % 100 - 8, 0) ELSE v END AS len FROM q),
    f AS (SELECT filename, st, CASE WHEN bool_or(n % 11 = 0) THEN false ELSE arg_min(out, n) END AS c FROM k GROUP BY 1, 2),
    s AS (SELECT filename, st, any_value(proto) AS proto, any_value(c) AS c, count(*) AS pkt_count, sum(len)::BIGINT AS payload_size, count(*) FILTER (out = c) AS fwd_pkt, coalesce(sum(len) FILTER (out = c), 0)::BIGINT AS fwd_byte,
        count(*) FILTER (out <> c) AS bwd_pkt, coalesce(sum(len) FILTER (out <> c), 0)::BIGINT AS bwd_byte, min(n) AS a, max(n) AS z,
        bool_or(n % 11 = 0 AND n % 22 <> 0)::INT AS has_SYN, bool_or(n % 22 = 0)::INT AS has_SYN_ACK, bool_or(n % 13 = 0 AND out = c)::INT AS has_FIN_cli, bool_or(n % 13 = 0 AND out <> c)::INT AS has_FIN_serv,
        bool_or(n % 17 = 0)::INT AS has_RST, bool_or(n % 5 = 0)::INT AS has_TLS_CHLO, bool_or(n % 7 = 0 AND n % 5 <> 0)::INT AS has_TLS_SHLO,
        coalesce('/a?q=%3Cscript%3E' || min(n) FILTER (n % 9 = 0), '-') AS http_susp_uri, 2 * count(*) FILTER (n % 8 = 0) AS tls_heartbeat, count(*) FILTER (n % 9 = 0) AS http_req_count,
        coalesce(CASE WHEN min(n) FILTER (n % 9 = 0) % 18 = 0 THEN 'POST' WHEN min(n) FILTER (n % 9 = 0) IS NOT NULL THEN 'GET' END, '-') AS http_method, coalesce('h' || (min(n) FILTER (n % 10 = 1) % 4), '-') AS http_host,
        coalesce('ua' || min(n) FILTER (n % 14 = 0), '-') AS http_ua, CASE WHEN bool_or(n % 16 = 3) THEN '404' ELSE '-' END AS http_resp_code, coalesce('text/' || (min(n) FILTER (n % 16 = 3) % 5), '-') AS http_content_type,
        coalesce('d' || min(n) FILTER (n % 12 = 5), '-') AS dns_qry, coalesce('s' || min(n) FILTER (n % 10 = 3), '-') AS tls_sni,
        coalesce(CASE WHEN min(n) FILTER (n % 23 = 0) % 46 = 0 THEN 'a|BotId' WHEN min(n) FILTER (n % 23 = 0) IS NOT NULL THEN 'b|c' END, '-') AS http_post_keys, bool_or(n % 46 = 0)::INT AS has_botid,
        coalesce('f' || min(n) FILTER (n % 19 = 0) || '.txt', '-') AS upload_filename, coalesce(substr('sip' || min(n) FILTER (n % 20 = 9) || repeat('x', 70), 1, 64), '-') AS sip_ua, bool_or(proto = 'udp' AND n % 24 = 0)::INT AS is_nmap_probe FROM k JOIN f USING (filename, st) GROUP BY 1, 2),
    i AS (SELECT filename, st, 'tcp dup ack ' || (n % 30) AS info, min(n) AS o FROM k WHERE n % 6 = 0 GROUP BY 1, 2, 3),
    j AS (SELECT *, sum(length(info)) OVER (PARTITION BY filename, st ORDER BY o ROWS UNBOUNDED PRECEDING) - length(info) AS before FROM i),
    arg AS (SELECT filename, st, string_agg(v, ' || ' ORDER BY o) AS ftp_arg FROM (SELECT filename, st, 'arg' || (n % 60) AS v, min(n) AS o FROM k WHERE n % 15 = 0 GROUP BY 1, 2, 3) GROUP BY 1, 2),
    ssh AS (SELECT filename, st, string_agg(v, ' || ' ORDER BY o) AS ssh_proto FROM (SELECT filename, st, 'SSH-2.0-x' || (n % 2) AS v, min(n) AS o FROM k WHERE n % 21 = 2 GROUP BY 1, 2, 3) GROUP BY 1, 2),
    w AS (SELECT filename, st, string_agg(info, ' || ' ORDER BY o) AS info FROM j WHERE before < 1000 GROUP BY 1, 2)
    SELECT filename, proto || '_' || st AS session_id, 'Malware' AS task1, 'DoS' AS task2, 'x' AS task3, '-' AS noise_label, 'eth' AS "L2", 'ip' AS "L3", proto AS "L4", CASE proto WHEN 'udp' THEN 'dns' ELSE 'tls' END AS "L7",
        CASE WHEN c THEN '10.0.0.' ELSE '10.1.0.' END || st AS src_ip, CASE WHEN c THEN '10.1.0.' ELSE '10.0.0.' END || st AS dst_ip, CASE WHEN c THEN server ELSE '50000' END AS dst_port, CASE WHEN c THEN '50000' ELSE server END AS src_port,
        pkt_count, payload_size, fwd_pkt, fwd_byte, bwd_pkt, bwd_byte, a || '.' || lpad((a % 1000)::VARCHAR, 6, '0') AS ts_first, z || '.' || lpad((z % 1000)::VARCHAR, 6, '0') AS ts_last,
        has_SYN, has_SYN_ACK, has_FIN_cli, has_FIN_serv, has_RST, has_TLS_CHLO, has_TLS_SHLO, http_susp_uri, http_susp_uri AS http_uri, coalesce(info, '-') AS ws_col_info,
        tls_heartbeat, http_req_count, http_method, http_host, http_ua, http_resp_code, http_content_type, dns_qry, tls_sni, http_post_keys, has_botid, upload_filename, sip_ua, is_nmap_probe, coalesce(ftp_arg, '-') AS ftp_arg, coalesce(ssh_proto, '-') AS ssh_proto
    FROM (SELECT *, CASE proto WHEN 'udp' THEN '111' ELSE '443' END AS server FROM s) AS s LEFT JOIN w USING (filename, st) LEFT JOIN arg USING (filename, st) LEFT JOIN ssh USING (filename, st)"""
ORACLES["class_renumber"] = "SELECT lang, 'f' || doc_id || '.pcap' AS name, lang || '_' || row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS new_name FROM documents"
ORACLES["randomise_identifiers"] = f"""
    WITH {_HEX}, k AS (SELECT doc_id, raw, 'f|' || doc_id AS k, {_crc_table()} AS t FROM h), c AS (SELECT doc_id, raw, {_CRC}::VARCHAR AS seed FROM k),
    a AS (SELECT doc_id, seed, substr(raw, 1, 24) || substr(md5(seed || '|' || substr(raw, 25, 16)), 1, length(substr(raw, 25, 16))) || substr(raw, 41) AS raw FROM c)
    SELECT doc_id, md5(substr(md5(seed || '|' || substr(raw, 1, 4)), 1, length(substr(raw, 1, 4))) || substr(raw, 5)) AS raw FROM a"""
ORACLES["gap_sessions"] = f"""
    WITH {P}, g AS (SELECT *, coalesce(us - lag(us) OVER (PARTITION BY user_id ORDER BY us) > 21600000000, true)::INT AS new FROM p),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, min(us) AS start_us, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, k"""

# Whole lists, and operators on them
_PARTS = "CASE WHEN contains(x.session_id, '_') THEN split_part(x.session_id, '_', 1) ELSE '-' END AS proto, CASE WHEN contains(x.session_id, '_') THEN substr(x.session_id, strpos(x.session_id, '_') + 1) ELSE '-' END AS stream"


def _list_sql(key: str, where: str, cap: int, least: int, ratio: float, seed: int) -> str:
    return f"""
    WITH {_MARKS}, x AS (SELECT m0.filename, m0.session_id, m0.task1, m0.task2, m0.task3, {key} AS group_key FROM m0 JOIN marks USING (event_id) WHERE {where}),
    n AS (SELECT *, count(*) OVER (PARTITION BY group_key) AS n, row_number() OVER (PARTITION BY group_key ORDER BY md5('{seed}|' || filename || '|' || session_id), filename, session_id) AS place FROM x),
    k AS (SELECT *, '{seed}|' || filename || '|' || session_id AS k, {_crc_table()} AS t FROM n WHERE n >= {least} AND place <= {cap}), r AS (SELECT *, {_CRC} AS hash FROM k)
    SELECT x.filename, x.session_id, {_PARTS}, group_key, task1, task2, task3, CASE WHEN hash / 4294967295.0 < {ratio} THEN 'test' ELSE 'train' END AS role FROM r AS x"""


ORACLES["list_denoised"] = _list_sql("m0.task1 || '_' || m0.task2 || '_' || m0.task3", "Aa_2 + Aa_4 + Cd_1 = 0 AND lower(m0.task1 || '_' || m0.task2 || '_' || m0.task3) NOT IN ('double_none_none', 'unlabeled_none_none')", 40, 30, 0.2, 42)
ORACLES["list_noisy_task"] = _list_sql("m0.task1", "lower(m0.task1) NOT IN ('double', 'unlabeled')", 10**9, 0, 0.3, 7)
ORACLES["feature_misses"] = "SELECT quality, count(*) FILTER (d.doc_id IS NULL) AS missing, sum(n_chars)::BIGINT AS n_chars FROM labels AS l LEFT JOIN (SELECT * FROM documents WHERE doc_id % 5 <> 0) AS d USING (doc_id) GROUP BY 1"
ORACLES["semi_pruned"] = "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)"
ORACLES["labelled_rows"] = "SELECT doc_id, (dense_rank() OVER (ORDER BY lang) - 1)::INT AS id FROM documents WHERE lang <> 'de'"
ORACLES["first_rows"] = "SELECT lang, source, doc_id, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY n_chars, doc_id) = 1"
ORACLES["listed_sort"] = "SELECT lang, row_number() OVER (ORDER BY CASE lang WHEN 'fr' THEN 1 WHEN 'en' THEN 2 ELSE 3 END, lang)::INT AS place FROM (SELECT DISTINCT lang FROM documents)"
ORACLES["session_names"] = "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN '-' ELSE event_type END AS proto, CASE WHEN event_id % 5 = 0 THEN '-' ELSE event_id::VARCHAR END AS stream FROM events"
ORACLES["field_maximum"] = f"WITH {P} SELECT event_id, max(value) OVER (PARTITION BY user_id, day ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS running_max FROM p"
ORACLES["top_feature"] = "SELECT l_returnflag, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY count(*) DESC, l_suppkey) = 1"
ORACLES["sampled_noise_rate"] = f"""
    WITH r AS (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY {_order(3)}) AS k FROM documents)
    SELECT lang, count(*) AS n, count(*) FILTER (n_chars < 400) AS noise, round(count(*) FILTER (n_chars < 400) / count(*), 4) AS rate FROM r WHERE k <= 60 GROUP BY 1"""
ORACLES["wrong_noise"] = "SELECT event_id, (event_id % 5 < 2)::INT AS hit FROM events WHERE event_id % 3 = 0"
ORACLES["seed_stats_models"] = """
    WITH v AS (SELECT user_id % 4 AS dataset, user_id % 3 AS model, event_id % 5 AS seed, avg(value) - 50 AS delta FROM events WHERE event_id % 11 = 0 GROUP BY 1, 2, 3),
    c AS (SELECT dataset, model, avg(delta) AS mean, stddev_samp(delta) AS sd FROM v GROUP BY 1, 2),
    m AS (SELECT dataset, avg(sd) AS within, stddev_samp(mean) AS between_, count(*) FILTER (mean > 0) AS positive, count(*) FILTER (mean < 0) AS negative FROM c GROUP BY 1),
    d AS (SELECT dataset, count(*) AS n, avg(delta) AS mean, stddev_samp(delta) AS sd FROM v GROUP BY 1),
    h AS (SELECT *, coalesce(list_value(12.706, 4.303, 3.182, 2.776, 2.571, 2.447, 2.365, 2.306, 2.262)[n - 1], 1.96) * sd / sqrt(n) AS half FROM d JOIN m USING (dataset))
    SELECT dataset, n, round(mean, 4) AS mean, round(within, 4) AS within, round(between_, 4) AS between, round(mean - half, 4) AS low, round(mean + half, 4) AS high, positive, negative,
        CASE WHEN abs(mean) <= 2 * within THEN 'within error' WHEN mean - half > 0 THEN '+' WHEN mean + half < 0 THEN '-' ELSE 'inconclusive' END AS verdict FROM h"""
