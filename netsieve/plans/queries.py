"""One query for each operator, over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from netsieve.functions import exprs
from netsieve.operators import analytics, bytesops, features, labels, lists, models, reports, rules, sessions
from netsieve.plans.adapters import markable, packets, table
from netsieve.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SESSION = ["user_id", "day"]
ORDER = ["us", "event_id"]


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _round(df: DataFrame, *names: str, digits: int = 4) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


# Sessions


@query
def session_accumulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = packets(spark, sf_dir)
    flags = [F.bool_or(F.col("event_type") == kind).cast("int").alias(name) for name, kind in (("has_syn", "signup"), ("has_fin", "purchase"), ("has_rst", "error"))]
    out = p.groupBy(*SESSION).agg(F.count("*").alias("pkt_count"), F.sum("value").alias("payload"), F.min("us").alias("first_us"), F.max("us").alias("last_us"), *flags)
    return _round(out, "payload")


@query
def session_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = packets(spark, sf_dir)
    kinds = p.groupBy(*SESSION, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("b"), F.min(F.struct(*ORDER)).alias("first"))
    opener = F.min_by("event_type", "first")
    out = kinds.groupBy(*SESSION).agg(opener.alias("client"), F.sum("n").alias("n"), F.sum("b").alias("b"), F.min_by("n", "first").alias("fwd_pkt"), F.min_by("b", "first").alias("fwd_byte"))
    out = out.select(*SESSION, "client", "fwd_pkt", "fwd_byte", (F.col("n") - F.col("fwd_pkt")).alias("bwd_pkt"), (F.col("b") - F.col("fwd_byte")).alias("bwd_byte"))
    return _round(out, "fwd_byte", "bwd_byte")


@query
def first_nonempty(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    there = (F.col("role") == "assistant") & (F.col("text") != "")
    return c.groupBy("conv_id").agg(F.md5(sessions.first_of(F.col("text"), there, "turn")).alias("first_answer"))


@query
def ordered_distinct_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.capped_distinct(packets(spark, sf_dir), SESSION, "us", "event_type", cap=12, least=4)


CHAINS = ["eth:ethertype:ip:tcp:tls", "eth:ip:udp:dns", "sll:ipv6:tcp:http:data", "eth:ip:tcp:nbss:smb2", "eth:arp", "raw:ip:icmp", "eth:ip:udp:data", "eth:ip:gre:ip:udp:stun"]


@query
def layer_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    chain = F.get(F.array(*map(F.lit, CHAINS)), (F.col("event_id") % len(CHAINS)).cast("int"))
    return e.select("event_id", *[c.alias(name) for name, c in exprs.layers(chain).items()])


@query
def task_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.regexp_replace("p_name", " ", "_")
    return table(spark, sf_dir, "part").select("p_partkey", *[exprs.task_part(name, n).alias(f"task{n}") for n in (1, 2, 3)])


@query
def wire_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole accumulator, on packet fields made from events."""
    e = table(spark, sf_dir, "events")
    stream, n = F.col("user_id") % 40, F.col("event_id")
    client, server = F.concat(F.lit("10.0.0."), stream), F.concat(F.lit("10.1.0."), stream)
    out = n % 2 == 0
    udp = stream % 4 == 0
    empty = F.lit("")
    fields = {
        "filename": F.concat(F.lit("Malware_DoS_x_"), F.col("user_id") % 3, F.lit(".pcap")),
        "class_name": F.lit("Malware_DoS_x"),
        "frame.number": n.cast("string"),
        "frame.protocols": F.when(udp, "eth:ip:udp:dns").otherwise("eth:ip:tcp:tls"),
        "tcp.stream": F.when(udp, empty).otherwise(stream.cast("string")),
        "udp.stream": F.when(udp, stream.cast("string")).otherwise(empty),
        "ip.src": F.when(out, client).otherwise(server),
        "ip.dst": F.when(out, server).otherwise(client),
        "tcp.srcport": F.when(udp, empty).when(out, "50000").otherwise("443"),
        "tcp.dstport": F.when(udp, empty).when(out, "443").otherwise("50000"),
        "udp.srcport": F.when(~udp, empty).when(out, "50000").otherwise("111"),
        "udp.dstport": F.when(~udp, empty).when(out, "111").otherwise("50000"),
        "udp.payload": F.when(udp & (n % 24 == 0), "72:FE:1d:13:00").otherwise(empty),
        "tcp.len": F.when(udp, empty).otherwise(F.col("value").cast("int").cast("string")),
        "udp.length": F.when(udp, (F.col("value").cast("int") % 100).cast("string")).otherwise(empty),
        "tcp.flags.syn": F.when(n % 11 == 0, "1").otherwise("0"),
        "tcp.flags.ack": F.when(n % 22 == 0, "1").otherwise("0"),
        "tcp.flags.fin": F.when(n % 13 == 0, "True").otherwise("0"),
        "tcp.flags.reset": F.when(n % 17 == 0, "0,1").otherwise("0"),
        "frame.time_epoch": F.format_string("%d.%06d", n, n % 1000),
        "tls.handshake.type": F.when(n % 5 == 0, "1").when(n % 7 == 0, "11,2").otherwise(""),
        "http.request.uri": F.when(n % 9 == 0, F.concat(F.lit("/a?q=%3Cscript%3E"), n)).otherwise(empty),
        "_ws.col.info": F.when(n % 6 == 0, F.concat(F.lit("TCP Dup ACK "), n % 30)).otherwise("plain"),
        "tls.record.content_type": F.when(n % 8 == 0, "24,22,24").otherwise(empty),
        "http.request.method": F.when(n % 18 == 0, "POST").when(n % 9 == 0, "GET").otherwise(empty),
        "http.host": F.when(n % 10 == 1, F.concat(F.lit("h"), n % 4)).otherwise(empty),
        "http.user_agent": F.when(n % 14 == 0, F.concat(F.lit("ua"), n)).otherwise(empty),
        "http.response.code": F.when(n % 16 == 3, "404").otherwise(empty),
        "http.content_type": F.when(n % 16 == 3, F.concat(F.lit("text/"), n % 5)).otherwise(empty),
        "dns.qry.name": F.when(n % 12 == 5, F.concat(F.lit("d"), n)).otherwise(empty),
        "tls.handshake.extensions_server_name": F.when(n % 10 == 3, F.concat(F.lit("s"), n)).otherwise(empty),
        "urlencoded-form.key": F.when(n % 46 == 0, "a,BotId,a").when(n % 23 == 0, "b,c").otherwise(empty),
        "mime_multipart.header.content-disposition": F.when(n % 19 == 0, F.concat(F.lit('form-data; filename="f'), n, F.lit('.txt"'))).otherwise(empty),
        "ftp.request.arg": F.when(n % 15 == 0, F.concat(F.lit("arg"), n % 60)).otherwise(empty),
        "ssh.protocol": F.when(n % 21 == 2, F.concat(F.lit("SSH-2.0-x"), n % 2)).otherwise(empty),
        "sip.User-Agent": F.when(n % 20 == 9, F.concat(F.lit("sip"), n, F.repeat(F.lit("x"), F.lit(70)))).otherwise(empty),
    }
    return sessions.accumulate(e.select(*[c.alias(name) for name, c in fields.items()]))


# Rules


@query
def rules_onehot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.mark(markable(spark, sf_dir)).select("event_id", *rules.CODES)


@query
def rules_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = rules.mark(markable(spark, sf_dir), scope={"Bb_28": ["GoldenEye", "Benign"], "Bb_29": ["DoS"]})
    return marked.select("event_id", "Bb_28", "Bb_29")


@query
def rule_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.report(rules.mark(markable(spark, sf_dir)))


@query
def perrule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.per_rule(rules.mark(markable(spark, sf_dir)))


@query
def perclass_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = rules.mark(markable(spark, sf_dir))
    group = F.when(F.lower("task1") == "benign", "benign").otherwise("attack")
    return rules.per_class(marked, rules.default_codes("cic18"), group, F.lower(F.concat_ws("_", "task1", "task2", "task3")))


@query
def any_noise_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = rules.mark(markable(spark, sf_dir))
    return lists.refine(marked, rules.any_mark(marked, rules.default_codes("vpn16")), "denoised").select("event_id", "task3")


# Labels


@query
def label_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = lambda c: F.datediff(F.col(c).cast("date"), F.lit("1970-01-01").cast("date")).cast("double")
    k = F.col("o_orderkey")
    s = table(spark, sf_dir, "orders").select("o_orderkey", day("o_orderdate").alias("t0")).withColumn("t1", F.col("t0") + F.when(k % 3 == 0, 2).otherwise(400))
    s = s.withColumns({"t0": F.when(k % 40 != 1, F.col("t0")), "t1": F.when(k % 40 != 2, F.col("t1"))})  # sessions without a time are damaged
    f = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), day("l_shipdate").alias("t"), "l_returnflag")
    s, f = s.withColumn("k", F.col("o_orderkey")), f.withColumnRenamed("o_orderkey", "k")
    return labels.interval_labels(s, f, ["k"], "o_orderkey", "t0", "t1", "t", "l_returnflag", benign="N", tolerance=30.0, twin=500.0)


SCHEDULE = [(1704060000, 1704070000, [1, 2, 3], [10, 11], "DoS"), (1704065000, 1704090000, [3, 4], [11, 12], "Bot"), (1704150000, 1704250000, [20, 21], [1, 30], "Scan")]


@query
def label_schedule_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    schedule = spark.createDataFrame(SCHEDULE, "start long, end long, attackers array<long>, victims array<long>, attack string")
    p = packets(spark, sf_dir).select("event_id", F.floor("t").alias("t"), (F.col("user_id") % 40).alias("a"), (F.col("event_id") % 40).alias("b"))
    return labels.schedule_labels(p, schedule, "event_id", "t", "a", "b", tolerance=120)


@query
def label_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.audit(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_returnflag", "N")


@query
def count_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("k")).agg(F.count("*").alias("n"))
    expected = table(spark, sf_dir, "region").select((F.col("r_regionkey") + 1).alias("k"), F.lit(5).alias("n"))
    return labels.count_check(n, expected, "k", "n")


@query
def sni_mode_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.regexp_extract("url", "://([^/?#]*)", 1)
    p = table(spark, sf_dir, "pages").select("page_id", host.alias("host"), F.array_join(F.slice(F.split(host, r"\."), -2, 2), ".").alias("domain"))
    return labels.dominant_suffix(p.withColumn("g", F.col("page_id") % 10), ["g"], "host", "domain", 20, "page_id")


# Keys and lists


@query
def content_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = packets(spark, sf_dir)
    a, b = F.concat(F.lit("10.0.0."), F.col("user_id") % 50), F.concat(F.lit("10.0.1."), F.col("event_id") % 50)
    flip = F.col("event_id") % 2 == 0
    sport, dport = F.lit("443.0"), (F.col("event_id") % 1000).cast("string")
    key = exprs.content_key(F.lit("tcp"), F.when(flip, a).otherwise(b), F.when(flip, sport).otherwise(dport), F.when(flip, b).otherwise(a), F.when(flip, dport).otherwise(sport), F.format_string("%d.%06d", (F.col("us") / 1_000_000).cast("long"), F.col("us") % 1_000_000))
    return p.select("event_id", key.alias("content_key"))


@query
def align_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.md5("text").alias("key"), F.concat(F.lit("f"), "doc_id").alias("filename"), F.concat(F.lit("tcp_"), F.col("doc_id") % 7).alias("session_id"), "doc_id")
    return lists.align(d.where("doc_id % 2 = 0").drop("doc_id"), d.where("doc_id % 3 <> 0"), "key", "filename", "session_id")


@query
def hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = markable(spark, sf_dir).select("filename", "session_id")
    return lists.roles(m, 42, "filename", "session_id").withColumn("hash", F.crc32(F.concat_ws("|", F.lit("42"), "filename", "session_id")))


@query
def split_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = markable(spark, sf_dir)
    noisy = lists.roles(m, 42, "filename", "session_id")
    clean = lists.roles(m.where("event_id % 2 = 0"), 42, "filename", "session_id")
    both = noisy.unionByName(clean).groupBy("filename", "session_id").agg(F.countDistinct("role").alias("r"))
    return both.agg(F.count("*").alias("sessions"), F.count_if(F.col("r") > 1).alias("leaking"))


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")


@query
def topk_per_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lists.top_per_class(_docs(spark, sf_dir), "lang", 25, 42, "doc_id").select("doc_id", "lang")


@query
def size_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir)
    return lists.size_match(d, d.where("n_chars > 2000"), "lang", 7, "doc_id").select("doc_id", "lang")


@query
def inject_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir)
    native = d.groupBy("lang").agg((F.count_if(F.col("n_chars") < 300) / F.count("*")).alias("rate"))
    return lists.inject(d.where("n_chars >= 300"), d.where("n_chars < 300"), "lang", native, 0.05, 42, "doc_id").select("doc_id", "lang", "is_noise")


@query
def at_least(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lists.at_least(_docs(spark, sf_dir), "lang", 120).select("doc_id", "lang")


@query
def label_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = lists.label_map(_docs(spark, sf_dir).where("lang IN ('en', 'fr')"), "lang")
    return lists.label_map(_docs(spark, sf_dir), "lang", old)


@query
def roundrobin_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lists.round_robin(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "label", 50, 42, "vec_id")


@query
def kfold_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lists.folds(table(spark, sf_dir, "labels"), "quality", 5, 42, "doc_id").select("doc_id", "fold")


@query
def inner_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lists.validation(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "label", 0.1, 5, 42, "vec_id")


# Features


def _flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = packets(spark, sf_dir)
    signed = F.when(F.col("event_type").isin("view", "click"), F.col("value")).otherwise(-F.col("value"))
    way = F.when(signed >= 0, 1).otherwise(-1)
    return features.flows(p.select("user_id", "us", "event_id", "t", signed.alias("size"), F.abs(signed).alias("bytes"), way.alias("way"), "event_type"), ["user_id"], ORDER, ["t", "size", "bytes", "way", "event_type"])


@query
def stats15(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = _flows(spark, sf_dir).select("user_id", F.transform("packets", lambda p: p["bytes"]).alias("v"))
    found = sizes.select("user_id", *[c.alias(name) for name, c in features.statistics(F.col("v")).items()])
    return _round(found, *features.STATISTICS, digits=6)


@query
def stats15_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _flows(spark, sf_dir).select("user_id", F.transform("packets", lambda p: p["size"]).alias("v"))
    ways = features.directional(F.col("v"))
    out = {}
    for way in ("Forward", "Backward"):
        for k in features.PREFIXES:
            found = features.statistics(features.prefix(ways[way], k))
            out |= {f"{way}_{k or 'All'}_{s}": F.round(found[s], 6) for s in features.STATISTICS if s not in ("skew", "kurt")}
    return f.select("user_id", *[c.alias(n) for n, c in out.items()])


@query
def flow_scalar2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = features.rates(F.col("packets"), "bytes", "t", "way")
    return _flows(spark, sf_dir).select("user_id", *[F.round(c, 4).alias(n) for n, c in found.items()])


@query
def iat(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = packets(spark, sf_dir)
    gaps = features.arrivals(p, SESSION, ORDER, "us", F.col("event_type").isin("view", "click"))
    return features.direction_index(gaps, SESSION, ORDER, F.col("event_type").isin("view", "click")).select("event_id", "iat", "dir_index")


@query
def psd_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = features.padded(F.transform("packets", lambda p: p["size"]), 100)
    long = _flows(spark, sf_dir).select("user_id", F.posexplode(v).alias("pos", "x"))
    return _round(long, "x")


@query
def flag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.transform("packets", lambda p: F.when(p["event_type"] == "signup", "S").when(p["event_type"] == "purchase", "FA").when(p["event_type"] == "view", "PA").otherwise("A"))
    return _flows(spark, sf_dir).select("user_id", *[c.alias(n) for n, c in features.flag_counts(names).items()])


@query
def derived14(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = session_direction(spark, sf_dir).join(session_accumulate(spark, sf_dir), SESSION)
    found = features.derived(F.col("pkt_count"), F.col("payload"), F.col("fwd_pkt"), F.col("fwd_byte"), F.col("bwd_pkt"), F.col("bwd_byte"), F.col("first_us") / 1e6, F.col("last_us") / 1e6)
    timed = F.col("last_us") > F.col("first_us")
    found |= {name: F.when(timed, found[name]) for name in ("pkt_rate", "byte_rate")}  # of single packets these are counts over 1e-9
    return s.select(*SESSION, *[F.round(c, 3).alias(n) for n, c in found.items()])


@query
def header_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.when(F.col("event_id") % 10 == 0, -1).otherwise((F.col("event_id") * 37 % 65536).cast("int"))
    high, low = features.high_low(value)
    return table(spark, sf_dir, "events").select("event_id", high.alias("high"), low.alias("low"))


# Bytes


def _hex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.lower(F.hex(F.col("text").cast("binary"))).alias("raw"))


@query
def image784(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _hex(spark, sf_dir).select("doc_id", bytesops.image(F.col("raw")).alias("v"))
    return v.select("doc_id", F.md5(F.array_join(F.transform("v", lambda x: (x * 256).cast("int").cast("string")), ",")).alias("image"))


@query
def matrix1600(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = lambda k: F.struct(F.substr("raw", F.lit(k * 600 + 1), F.lit(600)).alias("raw"), F.lit(40 + k).alias("header_len"))
    v = _hex(spark, sf_dir).select("doc_id", bytesops.matrix(F.array(*map(cut, range(6)))).alias("v"))
    return v.select("doc_id", F.md5(F.array_join(F.col("v").cast("array<string>"), ",")).alias("matrix"))


@query
def bigrams128(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hex(spark, sf_dir).select("doc_id", F.array_join(bytesops.bigrams(F.col("raw")), " ").alias("tokens"))


@query
def mask_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hex(spark, sf_dir).select("doc_id", F.md5(bytesops.masked(F.col("raw"), [(12, 20), (0, 4), (500, 504)])).alias("masked"))


@query
def uncond_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("lang", F.explode(bytesops.byte_values(F.lower(F.hex(F.col("text").cast("binary"))), 100)).alias("v"))
    return analytics.histogram(d, ["lang"], F.col("v"))


@query
def field_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "events").withColumn("packet", F.floor(F.col("event_id") / 4))
    return bytesops.field_runs(c, ["user_id"], "event_id", "packet", "event_type").select("event_id", "byte_index")


# Evaluation


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    guess = F.when(F.col("n_chars") % 5 == 0, F.lit("en")).when(F.col("doc_id") % 11 == 0, F.lit("xx")).otherwise(F.col("lang"))
    return d.select("doc_id", "source", F.col("lang").alias("truth"), guess.alias("pred"), (F.col("n_chars") < 400).alias("noise"))


@query
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.confusion(_predictions(spark, sf_dir), "truth", "pred")


@query
def class_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(analytics.class_scores(_predictions(spark, sf_dir), "truth", "pred"), "precision", "recall", "f1")


@query
def macro_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(analytics.macro_f1(_predictions(spark, sf_dir), "truth", "pred"), "macro_f1", "accuracy")


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    cell = e.groupBy((F.col("user_id") % 6).alias("dataset"), (F.col("user_id") % 5).alias("seed"), F.concat(F.lit("exp"), F.col("event_id") % 4 + 1).alias("exp"))
    return cell.agg(F.avg("value").alias("acc"))


@query
def result_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    exps = ["exp1", "exp2", "exp3", "exp4"]
    return _round(analytics.delta(analytics.result_pivot(_results(spark, sf_dir), ["dataset"], "exp", "acc", exps), "exp1", "exp3"), *exps, "delta")


@query
def seed_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    pivoted = analytics.delta(analytics.result_pivot(_results(spark, sf_dir), ["dataset", "seed"], "exp", "acc", ["exp1", "exp3"]), "exp1", "exp3")
    return _round(analytics.seed_statistics(pivoted, ["dataset"], "delta"), "mean", "sd", "least", "greatest", "half")


@query
def missing_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    have = table(spark, sf_dir, "nation").where("n_nationkey % 3 = 0").select("n_nationkey", F.col("n_regionkey").alias("r_regionkey"))
    return analytics.missing_cells([table(spark, sf_dir, "nation").select("n_nationkey"), table(spark, sf_dir, "region").select("r_regionkey")], have, ["n_nationkey", "r_regionkey"])


@query
def variant_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = analytics.result_pivot(_results(spark, sf_dir).where("seed < 3"), ["dataset", "seed"], "exp", "acc", ["exp1"])
    b = analytics.result_pivot(_results(spark, sf_dir).where("seed > 0"), ["dataset", "seed"], "exp", "acc", ["exp2", "exp3", "exp4"])
    return _round(analytics.blend(a, b, ["dataset", "seed"], "exp1", ["exp2", "exp3", "exp4"]), "exp1", "exp2", "exp3", "exp4")


@query
def noise_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir)
    return lists.minus(d, d.where("n_chars >= 400"), ["doc_id"]).select("doc_id")


@query
def evaluation_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _predictions(spark, sf_dir)
    out = analytics.lift(p.where("truth <> pred"), p.where("noise"), p, ["doc_id"], ["source"])
    return _round(out.withColumn("verdict", analytics.lift_verdict(F.col("lift"))), "lift")


@query
def error_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _predictions(spark, sf_dir).withColumn("pred4", F.when(F.col("doc_id") % 7 == 0, F.lit("zz")).otherwise(F.col("truth")))
    return analytics.error_composition(p, ["truth"], "truth", "pred", "pred4", F.col("noise"))


@query
def overlap_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _predictions(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return _round(analytics.overlap(p, F.col("noise"), F.coalesce(F.col("quality") == 0, F.lit(False)), ["source"]), "precision", "recall", "jaccard")


@query
def topk_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    a = li.groupBy("l_suppkey").agg(F.sum("l_quantity").alias("v"))
    b = li.groupBy("l_suppkey").agg(F.count("*").alias("v"))
    return _round(analytics.top_jaccard(a, b, "l_suppkey", "v", 30), "jaccard")


@query
def spearman_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_suppkey", "l_quantity", "l_discount")
    return _round(analytics.spearman(li.withColumn("g", F.col("l_suppkey") % 20), ["g"], "l_quantity", "l_discount"), "spearman")


@query
def spearman_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice", "o_custkey")
    return _round(analytics.spearman_ordinal(o, ["o_orderpriority"], "o_totalprice", "o_custkey", "o_orderkey"), "spearman")


@query
def mass_by_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "w"))
    return _round(analytics.mass(long.withColumn("w", F.col("w").cast("double")), "vec_id", ["pos"], "w"), "mass", digits=6)


@query
def separation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(analytics.davies_bouldin(table(spark, sf_dir, "embeddings"), "label", "embedding"), "davies_bouldin", "separation")


@query
def silhouette(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.silhouette(table(spark, sf_dir, "embeddings"), "vec_id", "label", "embedding", 3000, 42)


@query
def cl_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.confident_flags(table(spark, sf_dir, "embeddings"), "vec_id", "label", "embedding")


@query
def cl_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.confident_issues(models.held_out_probabilities(table(spark, sf_dir, "embeddings"), "vec_id", "label", "embedding"), "vec_id", "label")


@query
def reservoir_equiv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hash-ordered sample is the same however the rows are dealt."""
    d = _docs(spark, sf_dir)
    one = lists.top_per_class(d, "lang", 10, 1, "doc_id").select("doc_id")
    other = lists.top_per_class(d.repartition(7, "n_chars"), "lang", 10, 1, "doc_id").select("doc_id")
    return one.withColumn("a", F.lit(1)).join(other.withColumn("b", F.lit(1)), "doc_id", "full").agg(F.count("*").alias("n"), F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("differ"))


@query
def target_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = analytics.result_pivot(_results(spark, sf_dir), ["dataset", "seed"], "exp", "acc", ["exp1", "exp3"])
    return _round(reports.target_signal(wide, ["dataset"]), "mean_delta")


def _epochs(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where(F.col("event_type") == kind)
    return e.groupBy((F.col("user_id") % 40).alias("epoch")).agg(F.avg("value").alias("loss")).where("loss > 45")


@query
def convergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(reports.convergence(_epochs(spark, sf_dir, "view"), _epochs(spark, sf_dir, "click"), "epoch", "loss"), "a", "b", "gap")


@query
def last_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.last_epoch(table(spark, sf_dir, "events"), ["user_id"], "event_id", "value")


@query
def boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = _results(spark, sf_dir).withColumn("acc", F.col("acc") / 1000)
    return _round(reports.boundary(scores, ["dataset", "seed"], "exp", "acc"), "exp1", "exp3", "gap", digits=6)


@query
def importance_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    side = lambda k: p.where(F.col("p_partkey") % 3 != k).groupBy("p_type").agg(F.sum("p_retailprice").alias("v"))
    return _round(reports.importance_shift(side(0), side(1), "p_type", "v", "^(ECONOMY|PROMO)"), "spearman", "mass_a", "mass_b", "shift")


@query
def claim_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _results(spark, sf_dir).withColumn("key", F.concat_ws("_", "dataset", "seed", "exp"))
    return _round(reports.claims(r.where("seed < 4"), r.where("seed > 0").withColumn("acc", F.col("acc") - F.col("seed")), ["key", "dataset"], ["dataset"], "acc"), "a", "b")


@query
def class_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir)
    return reports.zero_filled(d, {"refined": d.where("n_chars > 1000"), "sampled": d.where("source = 'src1'")}, "lang")


@query
def class_renumber(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir).select("lang", F.concat(F.lit("f"), F.col("doc_id"), F.lit(".pcap")).alias("name"))
    return lists.renumber(d, "lang", "name")


@query
def randomise_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = bytesops.randomised(F.col("raw"), [(12, 20), (0, 2)], F.lit("f"), F.col("doc_id").cast("string"))
    return _hex(spark, sf_dir).select("doc_id", F.md5(new).alias("raw"))


@query
def gap_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "ts", "value")
    out = ingest.gap_sessions(e, "user_id", "ts", "value", gap="6 hours")
    return _round(out.select("user_id", F.unix_micros("start").alias("start_us"), "n", "total"), "total")


@query
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions, rules and refinement counts in one plan."""
    marked = rules.mark(markable(spark, sf_dir))
    counts = rules.per_class(marked, rules.CODES[:7], F.lit("all"), F.lower(F.col("task3")))
    rank = F.row_number().over(Window.orderBy(F.desc("before"), "class"))
    return counts.withColumn("place", rank)


# Whole lists, and operators on them


@query
def list_denoised(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = rules.mark(markable(spark, sf_dir))
    return lists.build(m, rules.any_mark(m, ["Aa_2", "Aa_4", "Cd_1"]), "denoised", excluded=("double_none_none", "unlabeled_none_none"), cap=40, least=30)


@query
def list_noisy_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = rules.mark(markable(spark, sf_dir))
    return lists.build(m, rules.any_mark(m), "noisy", task="task1", excluded=("double", "unlabeled"), ratio=0.3, seed=7)


@query
def feature_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = table(spark, sf_dir, "labels").select("doc_id", "quality")
    found = lists.with_features(listed, _docs(spark, sf_dir).where("doc_id % 5 <> 0").select("doc_id", "n_chars"), ["doc_id"])
    return found.groupBy("quality").agg(F.count_if(~F.col("found")).alias("missing"), F.sum("n_chars").alias("n_chars"))


@query
def semi_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lists.pruned(_docs(spark, sf_dir), table(spark, sf_dir, "labels").where("toxic = 1"), ["doc_id"]).select("doc_id", "lang")


@query
def labelled_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir)
    return lists.labelled(d, lists.label_map(d.where("lang <> 'de'"), "lang"), "lang").select("doc_id", "id")


@query
def first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lists.keep_first(_docs(spark, sf_dir), ["lang", "source"], "n_chars", "doc_id").select("lang", "source", "doc_id", "n_chars")


@query
def listed_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    place, name = exprs.listed_order(F.initcap("lang"), ["FR", "en"])
    d = table(spark, sf_dir, "documents").select("lang").distinct()
    return d.select("lang", F.row_number().over(Window.orderBy(place, name)).alias("place"))


@query
def session_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    proto, stream = exprs.session_parts(F.when(F.col("event_id") % 5 == 0, "-").otherwise(F.concat_ws("_", "event_type", F.col("event_id").cast("string"))))
    return table(spark, sf_dir, "events").select("event_id", proto.alias("proto"), stream.alias("stream"))


# Results


@query
def field_maximum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.running_max(packets(spark, sf_dir), SESSION, ORDER, "value").select("event_id", "running_max")


@query
def top_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_suppkey").agg(F.count("*").alias("n"))
    return analytics.top_feature(li, ["l_returnflag"], "l_suppkey", "n")


@query
def sampled_noise_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir)
    return _round(analytics.noise_rate(lists.top_per_class(d, "lang", 60, 3, "doc_id"), d.where("n_chars < 400"), ["doc_id"], ["lang"]), "rate")


@query
def wrong_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_id % 3 = 0")
    name = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("tcp_"), "event_id")).otherwise(F.concat("event_id", F.lit(".0")))
    wrong = e.select("event_id", (F.col("user_id") % 9).alias("file"), name.alias("session"))
    noise = e.where("event_id % 5 < 2").select((F.col("user_id") % 9).alias("file"), F.concat(F.lit("tcp_"), "event_id").alias("session"))
    return analytics.wrong_noise(wrong, noise, "file", "session").select("event_id", F.col("hit").cast("int").alias("hit"))


@query
def seed_stats_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_id % 11 = 0")
    values = e.groupBy((F.col("user_id") % 4).alias("dataset"), (F.col("user_id") % 3).alias("model"), (F.col("event_id") % 5).alias("seed")).agg((F.avg("value") - 50).alias("delta"))
    return _round(analytics.seed_statistics_by_model(values, ["dataset"], "model", "delta"), "mean", "within", "between", "low", "high")
