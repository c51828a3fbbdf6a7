"""The operators' queries over whole tables, and their SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netsieve.llm import byte_bpe, language_id, license_dice, pivot_search, poisson_mix, quality_bands, quote_links, secret_ledger, simhash_trie, url_trie


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fitted_bands(spark: SparkSession, docs: DataFrame, sf_dir: str) -> quality_bands.Bands:
    """Bands narrowed to the rows of docs that the table of labels calls good; the wide ones where there is no such table."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/labels.parquet")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return quality_bands.Bands()
    return quality_bands.fit(docs, _table(spark, sf_dir, "labels"))


def op1_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality_bands.quality_report(docs, bands=fitted_bands(spark, docs, sf_dir))


def op2_pivot_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_search.top_k(_table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op3_quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table holds no quotes, so its messages are first sent as mail, each quoting the two before it."""
    return quote_links.reply_order(quote_links.mailed(_table(spark, sf_dir, "conversations")))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    bpe = byte_bpe.ByteBpe(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return byte_bpe.digests(byte_bpe.encode_documents(_table(spark, sf_dir, "documents"), bpe))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "documents"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_ledger.report(secret_ledger.scan_documents(_table(spark, sf_dir, "documents")))


#: The rules of the url filter.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op7_url_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_trie.filter_urls(_table(spark, sf_dir, "pages"), rules)


def op8_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_trie.report(_table(spark, sf_dir, "documents"))


#: Target weights: every source the same, but for two.
MIX_WEIGHTS, MIX_OTHER, MIX_SEED = {"src0": 2.0, "src1": 0.5}, 1.0, 20240


def op9_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return poisson_mix.replicate(_table(spark, sf_dir, "documents"), MIX_WEIGHTS, MIX_SEED, other=MIX_OTHER)


def op10_license_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_dice.scan_licenses(_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_compression_bands,
        op2_pivot_search,
        op3_quote_links,
        op4_byte_bpe,
        op5_language_id,
        op6_secret_scan,
        op7_url_trie,
        op8_simhash_trie,
        op9_poisson_mix,
        op10_license_dice,
    )
}


#: The SQL's own wording of the secrets: kind, pattern, group, least characters of the group.
SECRETS = (
    ("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", "AKIA[A-Z0-9]+", 0, 18),
    ("hex", "[0-9a-f]+", 0, 16),
    ("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    ("forge", "gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
)


def _spans_sql() -> str:
    """The matches of every rule with their places, from matches and the text between them."""
    kinds = " UNION ALL ".join(
        f"""SELECT r, {order} AS o, '{kind}' AS kind, regexp_extract_all(t, $${pattern}$$) AS found, regexp_extract_all(t, $${pattern}$$, {group}) AS held,
            regexp_split_to_array(t, $${pattern}$$) AS gaps, {least} AS least FROM texts"""
        for order, (kind, pattern, group, least) in enumerate(SECRETS)
    )
    return f"""
        WITH texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
        matched AS ({kinds}),
        each AS (SELECT r, o, kind, found, gaps, least, held, unnest(range(1, len(found) + 1)) AS k FROM matched),
        placed AS (SELECT r, o, kind, length(held[k]) >= least AS fits, length(found[k]) AS n,
                          coalesce(list_sum(list_transform(gaps[:k], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(found[:k - 1], lambda x: length(x))), 0) AS s FROM each),
        spans AS (SELECT r, o, kind, s, kind || ':' || s::BIGINT || ':' || (s + n)::BIGINT AS span FROM placed WHERE fits)
        SELECT any_value(doc_id) AS doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
               sha256(coalesce(string_agg(span, ',' ORDER BY s, o) FILTER (o < 3), '')) AS base_sha256, coalesce(string_agg(span, ',' ORDER BY s, o), '') AS spans
        FROM texts LEFT JOIN spans USING (r) GROUP BY r"""


def _licenses_sql() -> str:
    """Every unit against every template, with no pruning but by size."""
    listed = ", ".join(f"('{name}', $t${text}$t$)" for name, text in license_dice.templates())
    plain = "trim(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
    cut = "string_split(regexp_replace(trim(regexp_replace({}, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')), '([.!?:]) ', '\\1' || chr(1), 'g'), chr(1))"
    pairs = "list_distinct(list_transform(range(1, len({0})), lambda k: {0}[k] || ' ' || {0}[k + 1]))"
    return f"""
        WITH given AS (SELECT DISTINCT license, x FROM (VALUES {listed}) AS v(license, x)),
        templates AS (SELECT license, {pairs.format('w')} AS b, n FROM (SELECT license, string_split({plain.format('x')}, ' ') AS w, len({cut.format('x')}) AS n FROM given)),
        texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
        parts AS (SELECT r, 0 AS run, unnest(list_concat(list_concat(string_split(t, chr(10)), string_split_regex(t, '\\n[ \\t]*\\n')), [t])) AS p FROM texts
                  UNION ALL SELECT r, n AS run, array_to_string(s[k:k + n - 1], ' ') FROM (SELECT r, s, n, unnest(range(1, len(s) - n + 2)) AS k FROM (SELECT r, {cut.format('t')} AS s FROM texts) JOIN (SELECT DISTINCT n FROM templates) ON n <= len(s))),
        units AS (SELECT DISTINCT r, run, {plain.format('p')} AS u FROM parts),
        words AS (SELECT r, run, u, string_split(u, ' ') AS w FROM units WHERE u LIKE '% %'),
        sets AS (SELECT r, run, u, {pairs.format('w')} AS a FROM words),
        met AS (SELECT r, u, license, 2.0 * len(list_intersect(a, b)) / (len(a) + len(b)) AS dice FROM sets JOIN templates ON run IN (0, n) AND len(a) * 3 <= len(b) * 5 AND len(b) * 3 <= len(a) * 5),
        chosen AS (SELECT r, u, arg_min(license, (-dice, license)) AS license, max(dice) AS dice FROM met WHERE dice >= 0.8 GROUP BY r, u),
        best AS (SELECT r, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses, round(max(dice), 9) AS best_dice, count(*) AS n FROM chosen GROUP BY r)
        SELECT doc_id, coalesce(licenses, '') AS licenses, best_dice, coalesce(n, 0) AS n_matches FROM texts LEFT JOIN best USING (r)"""


ORACLES = {
    "op2_pivot_search": """
        WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (SELECT a.r, a.vec_id AS query_id, b.vec_id AS vec_id, list_dot_product(a.q, b.q)::BIGINT AS score FROM v AS a JOIN v AS b ON a.vec_id % 50 = 0 AND a.r <> b.r)
        SELECT query_id, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST)::INTEGER AS rank, vec_id, score
        FROM scored QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) <= 5""",
    "op3_quote_links": r"""
        WITH RECURSIVE m AS (SELECT conv_id, turn, role, text, nullif(trim(lower(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))), '') AS plain FROM conversations),
        units AS (SELECT conv_id, turn, plain AS unit FROM m WHERE plain IS NOT NULL
                  UNION SELECT conv_id, turn, trim(lower(regexp_replace(u, '\s+', ' ', 'g'))) FROM (SELECT conv_id, turn, unnest(list_concat(string_split(text, chr(10)), string_split_regex(text, '\n\s*\n'))) AS u FROM m)),
        cut AS (SELECT a.conv_id, a.turn, back, unnest(range(1, len(p) + 1)) AS k, p FROM m AS a JOIN
                (SELECT conv_id, turn, list_filter(list_transform(string_split_regex(text, '\n\s*\n'), lambda x: trim(lower(regexp_replace(x, '\s+', ' ', 'g')))), lambda x: x <> '') AS p FROM m WHERE plain IS NOT NULL) AS b
                ON a.conv_id = b.conv_id JOIN (VALUES (1), (2)) AS v(back) ON b.turn + back = a.turn),
        quotes AS (SELECT conv_id, turn, back, k, p[k] AS passage FROM cut),
        linked AS (SELECT q.conv_id, q.turn, back, k, min(u.turn) AS up FROM quotes AS q LEFT JOIN units AS u ON u.conv_id = q.conv_id AND u.unit = q.passage AND u.turn < q.turn GROUP BY ALL),
        best AS (SELECT conv_id, turn, count(*) AS n_quotes, count(up) AS n_linked, arg_min(up, (back, k)) FILTER (up IS NOT NULL) AS up FROM linked GROUP BY 1, 2),
        tree AS (SELECT m.conv_id, m.turn, m.role, m.text, coalesce(n_quotes, 0) AS n_quotes, coalesce(n_linked, 0) AS n_linked, up FROM m LEFT JOIN best USING (conv_id, turn)),
        walk AS (SELECT conv_id, turn, turn AS root, 0 AS depth, [turn] AS path FROM tree WHERE up IS NULL
                 UNION ALL SELECT t.conv_id, t.turn, w.root, w.depth + 1, list_append(w.path, t.turn) FROM tree AS t JOIN walk AS w ON t.conv_id = w.conv_id AND t.up = w.turn)
        SELECT t.conv_id, t.turn, t.role, trim(coalesce(t.text, ''), chr(10)) AS text, n_quotes, n_linked, CASE WHEN up IS NOT NULL THEN t.conv_id END AS reply_conv, up AS reply_turn,
               t.conv_id AS root_conv, root AS root_turn, depth::BIGINT AS depth, row_number() OVER (PARTITION BY t.conv_id, root ORDER BY path) - 1 AS place
        FROM tree AS t JOIN walk AS w ON t.conv_id = w.conv_id AND t.turn = w.turn""",
    "op6_secret_scan": _spans_sql(),
    "op10_license_dice": _licenses_sql(),
    "op7_url_trie": r"""
        WITH cut AS (
            SELECT page_id, coalesce(regexp_matches(url, '(?s)://'), false) AS has,
                   translate(regexp_extract(url, '(?s)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS h,
                   regexp_extract(url, '(?s)://[^/?#]*([^?#]*)', 1) AS p
            FROM pages),
        parts AS (SELECT page_id, CASE WHEN has THEN h ELSE '' END AS host, CASE WHEN has THEN p ELSE '' END AS path FROM cut)
        SELECT page_id, host, path,
               CASE WHEN ('.' || host) LIKE '%.example.net' AND path LIKE '/en/%' THEN 'example.net/en/'
                    WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/de/%' THEN 'example.com/de/'
                    WHEN ('.' || host) LIKE '%.org' AND path LIKE '/fr/%' THEN 'org/fr/'
                    WHEN ('.' || host) LIKE '%.net' AND path LIKE '/%' THEN 'net/' END AS rule,
               CASE WHEN ('.' || host) LIKE '%.example.net' AND path LIKE '/en/%' THEN 'allow'
                    WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/de/%' THEN 'block'
                    WHEN ('.' || host) LIKE '%.net' AND path LIKE '/%' THEN 'block' ELSE 'allow' END AS verdict
        FROM parts""",
    "op9_poisson_mix": """
        WITH sizes AS (SELECT source, count(*) AS s FROM documents GROUP BY source),
        weighed AS (SELECT source, s, CASE source WHEN 'src0' THEN 2.0::DOUBLE WHEN 'src1' THEN 0.5 ELSE 1.0 END AS w FROM sizes),
        rates AS (SELECT source, w / (SELECT sum(w) FROM weighed) * (SELECT sum(s) FROM weighed)::DOUBLE / s AS rate FROM weighed),
        cut AS (SELECT source, greatest(ceil(rate / 64), 1) AS parts, rate / greatest(ceil(rate / 64), 1) AS mean FROM rates),
        terms AS (SELECT source, k, exp(k * ln(mean) - mean - lgamma(k + 1)) AS p
                  FROM (SELECT source, mean, unnest(range(0, (ceil(mean + 12 * sqrt(mean)) + 31)::BIGINT)) AS k FROM cut)),
        sums AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM terms),
        parted AS (SELECT row_number() OVER () AS r, d.*, unnest(range(0, parts::BIGINT)) AS part FROM documents AS d JOIN cut ON d.source IS NOT DISTINCT FROM cut.source),
        draws AS (SELECT *, ('0x' || substr(md5('20240|' || coalesce(doc_id::VARCHAR, '') || '|' || coalesce(md5(text), '') || CASE part WHEN 0 THEN '' ELSE '|' || part END), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM parted),
        counted AS (SELECT any_value(d) AS d, count(*) AS n FROM (SELECT draws AS d, r, part, u, source FROM draws) AS x
                    JOIN sums ON x.source IS NOT DISTINCT FROM sums.source AND sums.c <= x.u GROUP BY r, part)
        SELECT d.doc_id AS doc_id, d.text AS text, d.lang AS lang, d.source AS source, d.n_chars AS n_chars, d.part * 1024 + unnest(range(1, n + 1)) AS copy FROM counted""",
}
