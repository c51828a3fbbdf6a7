"""Rules, sessions, labels, lists, features, bytes and sources on small hand-made cases."""

from __future__ import annotations

import struct

import pytest
from pyspark.sql import functions as F

from netsieve.functions import exprs
from netsieve.operators import bytesops, features, labels, lists, models, rules, sessions
from netsieve.schemas import FIELDS, SESSION_COLUMNS
from netsieve.sources import pcap, pdml, text
from netsieve.streaming import ingest

CASES = [
    ({"L4": "tcp", "has_SYN": "1", "has_SYN_ACK": "0"}, {"Aa_1", "Aa_3"}),
    ({"L4": "tcp", "has_SYN": "1", "has_SYN_ACK": "1", "has_FIN_cli": "1", "dst_port": "443", "has_TLS_CHLO": "1", "has_TLS_SHLO": "0"}, {"Aa_5"}),
    ({"ws_col_info": "Malformed Packet"}, {"Aa_2", "Aa_4"}),
    ({"ws_col_info": "tcp dup ack"}, set()),
    ({"task1": "Double"}, {"Aa_6"}),
    ({"task3": "example.com", "tls_sni": "a.example.com"}, set()),
    ({"task3": "example.com", "tls_sni": "badexample.com"}, {"Bb_4"}),
    ({"task1": "Benign", "http_uri": "/?ABCD=EFGH"}, {"Bb_11"}),
    ({"task1": "Benign", "http_uri": "/?abcd=efgh"}, set()),
    ({"task1": "Benign", "http_uri": "/?aB1=xy&cD=zz"}, {"Bb_12"}),
    ({"task1": "x", "L4": "udp", "dst_ip": "100.64.0.9", "dst_port": "7001"}, {"Bb_6", "Bb_24"}),
    ({"task1": "x", "L4": "udp", "dst_ip": "100.128.0.9", "dst_port": "7001"}, {"Bb_24"}),
    ({"task1": "x", "src_ip": "10.0.0.1", "dst_ip": "192.168.0.5,10.1.1.255"}, {"Cc_5"}),
    ({"task1": "x", "src_ip": "205.174.165.70", "dst_ip": "8.8.8.8"}, set()),
    ({"task3": "GoldenEye", "has_RST": "1", "ts_first": "-", "ts_last": "-"}, {"Bb_20"}),
    ({"task2": "voip", "L7": "stun"}, {"Cc_4"}),
    ({"http_uri": "/msnxcom"}, {"Df_1"}),
    ({"task1": "Benign", "ftp_arg": "user\\t"}, {"Bb_9"}),
    ({"task1": "Benign", "http_susp_uri": "/a.gif?1=1"}, set()),
    ({"task1": "Benign", "http_susp_uri": "/a?1=1"}, {"Bb_5"}),
    ({"L3": "ipv6"}, {"Aa_7", "Cc_1"}),
    ({}, set()),
]


def test_rules(spark):
    names = sorted({n for case, _ in CASES for n in case})
    rows = [[k, *[case.get(n) for n in names]] for k, (case, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "k long, " + ", ".join(f"{n} string" for n in names)).withColumn("Aa_1", F.lit("old"))
    marked = rules.mark(df)
    for row in marked.collect():
        assert {c for c in rules.CODES if row[c]} == CASES[row.k][1], CASES[row.k]
    assert len(rules.CODES) == 50
    only_key = rules.mark(df.select("k"))
    assert rules.report(only_key).first()["any_noise"] == 0
    scoped = rules.marks(df, scope={"Bb_28": ["goldeneye"]})
    assert list(scoped) == list(rules.CODES)
    family = lambda s: {"Eg_1": s.l3 == "ipv6", "Aa_7": s.task1 == "double"}
    more = rules.mark(df, families=[family])
    assert more.where("Eg_1 = 1").count() == 1 and more.where("Aa_7 = 1").count() == 2
    assert rules.mark(df.limit(0)).count() == 0


def packet(frame, src, dst, **fields):
    row = dict.fromkeys(FIELDS, "") | {"filename": "a.pcap", "class_name": "Malware_DoS", "frame.number": str(frame), "tcp.stream": "0", "ip.src": src, "ip.dst": dst, "tcp.srcport": "1" if src == "c" else "2", "tcp.dstport": "2" if src == "c" else "1", "frame.time_epoch": f"{frame}.5", "frame.protocols": "eth:ip:tcp"}
    return row | {k.replace("__", "."): v for k, v in fields.items()}


def made(spark, rows):
    names = ["filename", "class_name", *FIELDS]
    return spark.createDataFrame([[r[n] for n in names] for r in rows], ", ".join(f"`{n}` string" for n in names))


def test_accumulator(spark):
    shake = [
        packet(1, "c", "s", tcp__flags__syn="1"),
        packet(2, "s", "c", tcp__flags__syn="1", tcp__flags__ack="True", **{"frame.protocols": "eth:ip:tcp:tls", "tls.handshake.type": "2,11"}),
        packet(3, "c", "s", tcp__flags__ack="1", tcp__len="10", **{"http.request.uri": "/a?q=%3Cscript%3E", "http.request.method": "GET"}),
        packet(4, "c", "s", tcp__flags__fin="0,1", tcp__flags__ack="1", **{"frame.protocols": "eth:ip:tcp:ssh"}),
    ]
    answer = [packet(5, "s", "c", tcp__flags__syn="1", tcp__flags__ack="1", **{"tcp.stream": "1"}), packet(6, "c", "s", tcp__flags__ack="1", **{"tcp.stream": "1"})]
    udp = [packet(k, "c", "s", **{"tcp.stream": "", "udp.stream": "4", "udp.length": str(n), "frame.protocols": "eth:ip:tcp:nbss:smb2", "_ws.col.info": f"x{k} retransmission " + "y" * 280}) for k, n in ((7, 8), (8, 20), (9, 3), (10, 8), (11, 8))]
    none = [packet(12, "c", "s", **{"tcp.stream": ""})]
    got = {r.session_id: r for r in sessions.accumulate(made(spark, shake + answer + udp + none)).collect()}
    assert set(got) == {"tcp_0", "tcp_1", "udp_4"}
    a, b, c = got["tcp_0"], got["tcp_1"], got["udp_4"]
    assert list(a.asDict()) == list(SESSION_COLUMNS)
    assert (a.has_SYN, a.has_SYN_ACK, a.has_FIN_cli, a.has_FIN_serv, a.src_ip, a.dst_ip) == (1, 1, 1, 0, "c", "s")
    assert (a.pkt_count, a.fwd_pkt, a.bwd_pkt, a.fwd_byte, a.payload_size) == (4, 3, 1, 10, 10)
    assert (a.L7, a.has_TLS_SHLO, a.has_TLS_CHLO, a.http_susp_uri, a.ts_first, a.ts_last) == ("tls", 1, 0, "/a?q=%3Cscript%3E", "1.500000", "4.500000")
    assert (a.task1, a.task2, a.task3) == ("Malware", "DoS", "-")
    assert (b.src_ip, b.fwd_pkt, b.bwd_pkt) == ("c", 1, 1)
    assert (c.payload_size, c.L7) == (12, "smb2")
    assert len(c.ws_col_info.split(" || ")) == 4  # 3 * 296 < 1000 <= 4 * 296
    assert sessions.accumulate(made(spark, none)).count() == 0


def test_expressions(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    assert value(F.crc32(F.lit("42|a.pcap|tcp_1"))) == 2655040731
    assert value(exprs.split_role(42, F.lit("a.pcap"), F.lit("tcp_1"))) == "train"
    assert [value(exprs.microseconds(F.lit(t))) for t in ("1.0000005", "1.0000015", "-")] == [1000000, 1000002, None]
    assert [value(exprs.plain_port(F.lit(p))) for p in ("443", "443.0", "-")] == ["443", "443", "-"]
    key = lambda a, b: value(exprs.content_key(F.lit("tcp"), F.lit(a), F.lit("1"), F.lit(b), F.lit("2.0"), F.lit("1.5")))
    assert key("x", "y") != key("y", "x") and len(key("x", "y")) == 16
    assert value(exprs.content_key(F.lit("tcp"), F.lit("x"), F.lit("1"), F.lit("y"), F.lit("2"), F.lit("1.5"))) == value(exprs.content_key(F.lit("tcp"), F.lit("y"), F.lit("2.0"), F.lit("x"), F.lit("1"), F.lit("1.500000")))
    names = spark.createDataFrame([("f10",), ("f2",), ("f2b",)], "n string")
    assert [r.n for r in names.orderBy(exprs.natural_key(F.col("n"))).collect()] == ["f2", "f2b", "f10"]
    assert [value(c) for c in exprs.session_parts(F.lit("tcp_12"))] == ["tcp", "12"] and [value(c) for c in exprs.session_parts(F.lit("-"))] == ["-", "-"]


def test_labels(spark):
    s = spark.createDataFrame([(1, "k", 100.0, 110.0), (2, "k", 43300.0, 43301.0), (3, "none", 1.0, 2.0), (4, "m", 0.0, 100.0), (5, "k", 500.0, 501.0)], "sid long, key string, a double, b double")
    f = spark.createDataFrame([("k", 105.0, "DoS"), ("m", 5.0, "X"), ("m", 6.0, "Y"), ("k", 9000.0, "far")], "key string, t double, label string")
    got = {r.sid: (r.label, r.how) for r in labels.interval_labels(s, f, ["key"], "sid", "a", "b", "t", "label", "BENIGN", twin=43200.0).collect()}
    assert got == {1: ("DoS", "inside"), 2: ("DoS", "nearest"), 3: ("unlabeled", "unlabeled"), 4: ("double", "double"), 5: ("DoS", "nearest")}
    plan = spark.createDataFrame([(10, 20, ["a"], ["v"], "Bot"), (15, 30, ["a", "b"], ["v"], "DoS")], "start long, end long, attackers array<string>, victims array<string>, attack string")
    e = spark.createDataFrame([(1, 12, "a", "v"), (2, 30, "v", "b"), (3, 16, "a", "v"), (4, 31, "b", "v"), (5, 12, "a", "x")], "sid long, t long, x string, y string")
    assert {r.sid: r.label for r in labels.schedule_labels(e, plan, "sid", "t", "x", "y").collect()} == {1: "Bot", 2: "DoS", 3: "double", 4: "Benign", 5: "Benign"}
    one = spark.createDataFrame([("DoS Hulk",), ("New  Thing",)], "l string")
    assert [r[0] for r in one.select(labels.triple(F.col("l"), labels.FLOW_LABELS)).collect()] == ["Malware/DoS/Hulk", "Malware/New-Thing/New-Thing"]


def test_damaged_labels(spark):
    s = spark.createDataFrame([(1, "k", None, 110.0), (2, "k", 100.0, None), (3, "none", None, None), (4, "k", 100.0, 110.0)], "sid long, key string, a double, b double")
    f = spark.createDataFrame([("k", 105.0, "DoS"), ("k", 9000.0, "far")], "key string, t double, label string")
    got = {r.sid: (r.label, r.how) for r in labels.interval_labels(s, f, ["key"], "sid", "a", "b", "t", "label", "BENIGN").collect()}
    assert got == {1: ("damaged", "damaged"), 2: ("damaged", "damaged"), 3: ("damaged", "damaged"), 4: ("DoS", "inside")}


def test_lists(spark):
    copies = spark.createDataFrame([("k", "f10", "tcp_1"), ("k", "f2", "tcp_1")], "key string, filename string, session_id string")
    listed = spark.createDataFrame([("k", "b1", "tcp_9"), ("k", "b2", "tcp_9"), ("k", "b3", "tcp_9"), ("z", "c", "-")], "key string, filename string, session_id string")
    got = {r.filename: r.found_filename for r in lists.align(listed, copies, "key", "filename", "session_id").collect()}
    assert got == {"b1": "f2", "b2": "f10", "b3": "f2", "c": None}
    names = lambda text: spark.createDataFrame([("k", n, "-") for n in text.split()], "key string, filename string, session_id string")
    found = {r.filename: r.found_filename for r in lists.align(names("l0 l1 l2 l3"), names("a l2"), "key", "filename", "session_id").collect()}
    assert found == {"l0": "a", "l1": "a", "l2": "l2", "l3": "a"}  # the same name first, then the free copy, then the first one again
    clean = spark.createDataFrame([(k, "a") for k in range(10)], "id long, g string")
    noisy = spark.createDataFrame([(100 + k, "a") for k in range(5)], "id long, g string")
    native = spark.createDataFrame([("a", 0.20)], "g string, rate double")
    mixed = lists.inject(clean, noisy, "g", native, 0.05, 42, "id")
    assert (mixed.count(), mixed.where("is_noise = 1").count()) == (10, 2)  # 2.5 rounds to 2
    d = spark.range(100).withColumn("g", F.col("id") % 3)
    one = {r.id for r in lists.top_per_class(d, "g", 5, 1, "id").collect()}
    assert len(one) == 15 and one == {r.id for r in lists.top_per_class(d.repartition(7), "g", 5, 1, "id").collect()}
    old = lists.label_map(d.where("g > 0"), "g")
    assert {r.label: r.id for r in lists.label_map(d, "g", old).collect()} == {1: 0, 2: 1, 0: 2}
    single = lists.label_map(d.where("g = 1"), "g")
    assert {r.label: r.id for r in lists.label_map(d, "g", single).collect()} == {1: 0, 0: 1, 2: 2}
    names = lists.renumber(spark.createDataFrame([("a", "f10"), ("a", "f9")], "g string, n string"), "g", "n")
    assert {r.n: r.new_name for r in names.collect()} == {"f9": "a_1", "f10": "a_2"}


def test_features(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0, 4.0, 9.0]), (2, [0.0]), (3, [5.0]), (4, [3.0, 3.0]), (5, [])], "k long, v array<double>")
    got = {r.k: r for r in rows.select("k", *[c.alias(n) for n, c in features.statistics(F.col("v")).items()]).collect()}
    assert got[1].q25 == 1.75 and got[1]["var"] == 9.5 and got[1].skew == pytest.approx(0.768417, abs=1e-6) and got[1].kurt == pytest.approx(-1.0, abs=1e-2)
    assert all(got[k]["sum"] is None and got[k].skew is None for k in (2, 5))
    assert (got[3]["sum"], got[3].sstd, got[3].skew, got[4].kurt) == (5.0, 0.0, None, None)
    sizes = spark.createDataFrame([([60.0, -40.0, 60.0],)], "v array<double>")
    ways = sizes.select(*[c.alias(n) for n, c in features.directional(F.col("v")).items()]).first()
    assert (ways.Forward, ways.Backward, ways.Both) == ([60, 60], [40], [60, 40, 60])
    assert len(features.scalar_block("iat", F.col("v"))) == 315
    assert features.feature_set(["flag_S", "iat_x", "ip_ttl"], "no_headerflags") == ["iat_x"]


def test_bytes(spark):
    runs = spark.createDataFrame([(0, 3, 1), (1, 3, 1), (2, 5, 1), (3, 3, 2)], "pos long, field long, pkt long").withColumn("k", F.lit(1))
    got = bytesops.field_runs(runs, ["k"], "pos", "pkt", "field").orderBy("pos").collect()
    assert [r.byte_index for r in got] == [1, 2, 1, 1]
    one = spark.createDataFrame([("0aff10",), ("",)], "h string")
    tokens = [r[0] for r in one.select(bytesops.bigrams(F.col("h"), 4)).collect()]
    assert tokens == [["0aff", "ff10", "0000", "0000"], ["0000"] * 4]
    assert [r[0] for r in one.select(bytesops.masked(F.col("h"), [(1, 2), (2, 9)])).collect()] == ["0a0000", ""]
    assert one.select(bytesops.image(F.col("h"), 4)).first()[0] == [10 / 256, 255 / 256, 16 / 256, 257 / 256]


def capture(packets, order="<"):
    head = struct.pack(order + "IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
    return head + b"".join(struct.pack(order + "4I", 7, 500000, len(p), len(p)) + p for p in packets)


def frame(flags=0x12):
    ip = bytes([0x45, 0, 0, 40, 0, 0, 0, 0, 64, 6, 0, 0, 10, 0, 0, 1, 8, 8, 8, 8])
    return b"\0" * 12 + b"\x08\x00" + ip + struct.pack("!HHIIBBHHH", 1234, 443, 0, 0, 0x50, flags, 0, 0, 0)


def test_pcap(spark, tmp_path):
    (tmp_path / "Malware_x").mkdir()
    (tmp_path / "Malware_x/a.pcap").write_bytes(capture([frame(), frame(0x02)]) + b"\1\2\3")
    (tmp_path / "Malware_x/b.pcap").write_bytes(capture([frame()], ">"))
    (tmp_path / "Malware_x/c.pcap").write_bytes(b"nothing")
    got = pcap.read(spark, f"file://{tmp_path}/*/*.pcap").orderBy("filename", "frame").collect()
    assert [(r.filename, r.frame, r.ts, r.src, r.dport, r.flags, r.class_name) for r in got] == [
        ("a.pcap", 1, 7.5, "10.0.0.1", 443, "SA", "Malware_x"),
        ("a.pcap", 2, 7.5, "10.0.0.1", 443, "S", "Malware_x"),
        ("b.pcap", 1, 7.5, "10.0.0.1", 443, "SA", "Malware_x"),
    ]
    assert bytes(got[0].raw) == frame()[14:]
    assert [pcap.kind(x) for x in (b"", b"\x0a\x0d\x0d\x0a", capture([]))] == ["other", "pcapng", "pcap"]


def ip_packet(src, dst, sport, dport, flags, payload=b"", udp=False):
    l4 = struct.pack("!HHHH", sport, dport, 8 + len(payload), 0) if udp else struct.pack("!HHIIBBHHH", sport, dport, 0, 0, 0x50, flags, 0, 0, 0)
    size = 20 + len(l4) + len(payload)
    ip = struct.pack("!BBHHHBBH4B4B", 0x45, 0, size, 0, 0, 64, 17 if udp else 6, 0, *src, *dst)
    return b"\0" * 12 + b"\x08\x00" + ip + l4 + payload + b"\0" * 3  # padding is no payload


def test_capture_to_sessions(spark, tmp_path):
    c, s = (10, 0, 0, 1), (8, 8, 8, 8)
    sent = [
        ip_packet(c, s, 5000, 80, 0x02), ip_packet(s, c, 80, 5000, 0x12), ip_packet(c, s, 6000, 53, 0, b"ab", udp=True),
        ip_packet(c, s, 5000, 80, 0x18, b"GET /x?a=1 HTTP/1.1\r\nHost: h.example\r\nUser-Agent: zgrab\r\n\r\n"), ip_packet(s, c, 80, 5000, 0x18, b"HTTP/1.1 404 No\r\nContent-Type: text/html\r\n\r\n"),
        ip_packet(c, s, 5001, 80, 0x04), ip_packet(s, c, 80, 5000, 0x11),
    ]
    (tmp_path / "Malware_DoS").mkdir()
    (tmp_path / "Malware_DoS/a.pcap").write_bytes(capture(sent))
    (tmp_path / "Malware_DoS/b.pcap").write_bytes(b"nothing here, no capture at all")
    (tmp_path / "Malware_DoS/c.pcap").write_bytes(capture([]))
    rows = pcap.streams(pcap.read(spark, f"file://{tmp_path}/*/a.pcap"))
    assert [(r.proto, r.stream) for r in rows.orderBy("frame").collect()] == [("tcp", 0), ("tcp", 0), ("udp", 0), ("tcp", 0), ("tcp", 0), ("tcp", 1), ("tcp", 0)]
    got = {r.session_id: r for r in sessions.accumulate(pcap.fields(rows)).collect()}
    a = got["tcp_0"]
    assert set(got) == {"tcp_0", "tcp_1", "udp_0"} and (a.src_ip, a.dst_ip, a.dst_port, a.L7, a.task1) == ("10.0.0.1", "8.8.8.8", "80", "http", "Malware")
    assert (a.pkt_count, a.fwd_pkt, a.has_SYN, a.has_SYN_ACK, a.has_FIN_cli, a.has_FIN_serv, a.has_RST) == (5, 2, 1, 1, 0, 1, 0)
    assert (a.http_method, a.http_uri, a.http_host, a.http_ua, a.http_resp_code, a.http_content_type) == ("GET", "/x?a=1", "h.example", "zgrab", "404", "text/html")
    assert (a.fwd_byte, a.bwd_byte, got["udp_0"].payload_size, got["tcp_1"].has_RST) == (59, 44, 2, 1)
    assert {r.path[-6:]: r.reason for r in pcap.unreadable(spark, f"file://{tmp_path}/*/*.pcap").collect()} == {"b.pcap": "no capture", "c.pcap": "no packets"}


def test_text_sources(spark, tmp_path):
    (tmp_path / "cls").mkdir()
    (tmp_path / "cls/p.tsv").write_text("\t".join(["1", "eth:ip:tcp", "0"] + [""] * 33) + "\n")
    row = text.packet_fields(spark, f"file://{tmp_path}/cls/*.tsv").first()
    assert (row.filename, row.class_name, row["frame.number"], row["sip.User-Agent"]) == ("p.tsv", "cls", "1", "")
    (tmp_path / "flows.csv").write_bytes(b"id,src,sp,dst,dp,proto,time,label\nx,1.1.1.1,80,2.2.2.2,443,6,1/1/2017 1:00,Web Attack \x96 XSS\nshort,row\n")
    flows = text.flow_log(spark, f"file://{tmp_path}/flows.csv").collect()
    assert len(flows) == 1 and flows[0].dst_port == "443" and flows[0].label.endswith("XSS")
    text.write_chunked(spark.range(25).withColumn("x", F.lit(None).cast("string")), f"file://{tmp_path}/out", rows=10)
    back = text.sessions(spark, f"file://{tmp_path}/out", ["id", "x"])
    assert back.count() == 25 and {r.x for r in back.collect()} == {"-"}


def test_label_maps_and_manifests(spark, tmp_path):
    labels_ = spark.createDataFrame([('b "x", y', 1), ("a", 0), ("é", 2)], "label string, id int")
    text.write_label_map(labels_, f"file://{tmp_path}/map")
    back = {r.label: r.id for r in text.read_label_map(spark, f"file://{tmp_path}/map").collect()}
    assert back == {'b "x", y': 1, "a": 0, "é": 2}
    rows = spark.createDataFrame([("f1", 1), ("f2", 2)], "filename string, n long")
    done = spark.createDataFrame([("f1",), ("f1",)], "filename string")
    assert [r.n for r in text.finished(rows, done).collect()] == [1] and [r.n for r in text.unread(spark, rows, done).collect()] == [2]
    text.write_errors(spark.createDataFrame([("p", "not\ta capture")], "path string, reason string"), f"file://{tmp_path}/errors")
    assert [r.value for r in spark.read.text(f"file://{tmp_path}/errors").collect()] == ["p\tnot a capture"]
    files = spark.createDataFrame([("x.pcap", 1, "b/x.pcap"), ("x.pcap", 0, "a/x.pcap")], "name string, root long, path string")
    assert [r.path for r in pcap.index(files, "name", "root").collect()] == ["a/x.pcap"]


def test_model_surface(spark):
    rows = spark.createDataFrame([(k, float(k % 2) + k / 100, float(k), "ab"[k % 2], k % 2, int(k % 5 == 0), 0, int(k % 7 == 0)) for k in range(40)], "key long, x double, y double, g string, label long, rule_noise long, cl_issue long, cl_budget long")
    forest = models.fit_forest(rows, rows.withColumn("x", F.when(F.col("key") > 0, F.col("x"))), ["x", "y"], "label", trees=10)
    assert forest.where("prediction = label").count() >= 38 and forest.count() == 40
    sizes = {c: models.removal(rows, c).count() for c in ("raw", "rule", "cl_default", "cl_budget", "random")}
    assert sizes == {"raw": 40, "rule": 32, "cl_default": 40, "cl_budget": 34, "random": 32}
    flags = spark.createDataFrame([(1, 0.5), (2, 0.1), (3, 0.1)], "key long, quality double")
    assert [r.key for r in models.lowest_quality(flags, "key", 2).collect()] == [2, 3]
    runs = spark.createDataFrame([(r["dataset"], r["seed"], r["exp"]) for r in models.grid(["d"], ["m"], ("full",))], "dataset string, seed long, exp string")
    assert models.unfinished(runs, runs.limit(3), ["dataset", "seed", "exp"]).count() == 17
    assert [r.l for r in lists.exclude(spark.createDataFrame([("Twitter",), ("x",)], "l string"), F.col("l"), ("twitter",)).collect()] == ["x"]


def test_confident_issues(spark):
    """A wrong label in each of two clear classes, one of which has a single other row, and a class of one row."""
    rows = [(k, 0, [0.0 + k / 100, 0.0]) for k in range(20)] + [(100 + k, 1, [9.0, k / 100]) for k in range(20)] + [(200, 1, [0.05, 0.0]), (201, 0, [9.0, 0.05]), (300, 2, [50.0, 50.0])]
    df = spark.createDataFrame(rows, "key long, label long, v array<double>")
    got = {r.key: r for r in models.confident_issues(models.held_out_probabilities(df, "key", "label", "v"), "key", "label").collect()}
    assert {k for k, r in got.items() if r.is_issue} == {200, 201} and len(got) == len(rows)
    assert got[200].quality < 0.01 < 0.99 < got[0].quality and got[300].quality is None  # nobody else vouches for a class of one row
    assert models.confident_issues(models.held_out_probabilities(df.limit(0), "key", "label", "v"), "key", "label").count() == 0


def test_clocks_and_keys(spark):
    times = spark.createDataFrame([("03/07/2017 02:10:05",), ("3/7/2017 14:10",), ("-",)], "t string")
    assert [str(r[0]) for r in times.select(labels.clock(F.col("t"), 3)).collect()] == ["2017-07-03 05:10:05", "2017-07-03 17:10:00", "None"]
    both = spark.createDataFrame([("a", "1", "b", "2"), ("b", "2", "a", "1")], "s string, sp string, d string, dp string")
    assert len({r[0] for r in both.select(labels.ends_key(*map(F.col, ("s", "sp", "d", "dp")), F.lit("tcp"))).collect()}) == 1
    stream = spark.createDataFrame([([("0aff10",), ("01",)],)], "p array<struct<raw: string>>").select(bytesops.bigram_stream(F.col("p"), 6, each=2)).first()[0]
    assert stream == ["[SEP]", "0aff", "ff10", "[SEP]", "0000", "0000"]


def test_list_builder(spark):
    rows = [(f"f{k}", f"tcp_{k}", "A", "b", "c" if k % 3 else "D", k % 4) for k in range(60)] + [("g", "-", "double", "x", "y", 0)]
    m = spark.createDataFrame(rows, "filename string, session_id string, task1 string, task2 string, task3 string, noise long")
    noisy = F.col("noise") == 1
    made = lists.build(m, noisy, "denoised", excluded=("DOUBLE_X_Y".lower(),), cap=10, least=16)
    assert made.columns == ["filename", "session_id", "proto", "stream", "group_key", "task1", "task2", "task3", "role"]
    assert {r.group_key for r in made.collect()} == {"A_b_c"} and made.count() == 10
    whole = {(r.filename, r.role) for r in lists.build(m, noisy, "noisy").collect()}
    assert {(r.filename, r.role) for r in made.collect()} <= whole and len(whole) == 61  # one role in every list
    assert lists.build(m.limit(0), noisy, "noisy", cap=3, least=2).count() == 0
    null = m.withColumn("g", F.when(F.col("noise") < 2, "x"))
    ranked = lists.class_ranks(null, "g", 1, "filename")
    assert sorted((r.g or "", r._rank, r._total) for r in ranked.collect()) == sorted((g, k + 1, n) for g, n in (("x", 31), ("", 30)) for k in range(n))


def test_models(spark):
    assert len(models.grid(["d"], ["rf"])) == 60
    old = spark.createDataFrame([("a", 1, 0.5), ("b", 1, 0.9)], "d string, e long, v double")
    new = spark.createDataFrame([("a", 1, 0.7), ("b", 1, 0.1), ("c", 2, 0.2)], "d string, e long, v double")
    assert {r.d: r.v for r in models.keep_better(old, new, ["d", "e"], "v").collect()} == {"a": 0.7, "b": 0.9, "c": 0.2}


def test_streaming(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00", 1.0), (1, "2024-01-01 00:10:00", 2.0), (1, "2024-01-01 02:00:00", 4.0)], "u long, t string, v double")
    rows.write.parquet(f"{tmp_path}/in")
    stream = ingest.files(spark, f"{tmp_path}/in", rows.schema)
    for _ in range(2):  # the second finds nothing new
        ingest.drain(stream, f"{tmp_path}/out", f"{tmp_path}/check")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 3
    assert sorted((r.n, r.total) for r in ingest.gap_sessions(rows, "u", "t", "v").collect()) == [(1, 4.0), (2, 3.0)]


def test_pdml(spark, tmp_path):
    (tmp_path / "d.pdml").write_text('<pdml><packet><proto name="ip" pos="0" size="4"><field name="ip.len" pos="1" size="2"/></proto></packet><packet><proto name="x" pos="0" size="1"/></packet><packet>')
    rows = pdml.read(spark, f"file://{tmp_path}/d.pdml")
    assert sorted((r.frame, r.pos, r.field) for r in rows.collect()) == [(1, 0, "ip"), (1, 1, "ip.len"), (1, 2, "ip.len"), (1, 3, "ip"), (2, 0, "x")]
    assert {r.field: r.field_id for r in pdml.vocabulary(rows).collect()} == {"<pad>": 0, "ip": 1, "ip.len": 2, "x": 3}
