"""The pipeline against plain code, stage by stage, and the registry."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import zstandard
from pyspark.sql import functions as F
from test_operators import DOCS, SECRETS, brute_components, brute_print, counts, prose, reference_codec

import corpus_pipeline
from netsieve.llm import quality_bands, secret_ledger
from netsieve.llm.registry import MIX_OTHER, MIX_SEED, MIX_WEIGHTS, ORACLES, QUERIES


def fixture():
    rng = random.Random(8)
    rows = []
    for k in range(60):
        text = prose(80 + 5 * k, k)
        rows.append((k, text, "en", f"src{k % 3}", len(text)))
    for k in range(60, 75):  # near copies of the first one
        words = rows[0][1].split()
        words[rng.randrange(len(words))] = "new"
        text = " ".join(words)
        rows.append((k, text, "en", "src0", len(text)))
    rows += [(80 + k, rows[k][1], "en", "src1", rows[k][4]) for k in range(5)]
    secret = prose(90, 99) + " " + SECRETS[3] + " tail"
    rows += [(90, secret, "en", "src2", len(secret)), (91, secret, "en", "src2", len(secret))]
    rows += [(92, None, "en", "src1", None), (93, "", None, None, 0), (94, "again " * 300, "en", "src1", 1800), (None, prose(77, 7), "en", "src1", 1), (5, rows[5][1], "en", "src2", 9)]
    rows += [(7, prose(88, 55), "en", "src0", 2), (None, prose(77, 7), "en", "src2", 3), (None, rows[9][1], "en", "src1", 4), (7, rows[0][1], "en", "src1", 5)]  # one id with three texts, copies without an id
    return rows


def passes(text):
    bands = quality_bands.Bands()
    n, _, _, _, repeat = counts(text)
    if n < 50 or 100 * repeat > 50 * n:
        return False
    press, raw = zstandard.ZstdCompressor(level=bands.level), text.encode()
    share = lambda x: len(press.compress(x)) / len(x)
    low, high = next((lo, hi) for below, lo, hi in bands.whole if len(raw) < below)
    parts = [raw[k : k + 4096] for k in range(0, len(raw), 4096) if k == 0 or len(raw) - k >= 2048] if len(raw) > 4096 else []
    return low <= share(raw) <= high and 4 * sum(not bands.chunk[0] <= share(x) <= bands.chunk[1] for x in parts) <= len(parts)


def redacted(text):
    spans = []
    for rule in secret_ledger.RULES:
        spans += [m.span() for m in re.finditer(rule.pattern, text) if len(m[rule.group]) >= rule.least]
    out, at = "", 0
    for start, end in sorted(spans):
        if start >= at:
            out += text[at:start] + "[SECRET]"
        at = max(at, end)
    return out + text[at:]


def copies(rows):
    sizes = Counter(r[3] for r in rows)
    weight = {s: MIX_WEIGHTS.get(s, MIX_OTHER) for s in sizes}
    found = Counter()
    for r in rows:
        mean = weight[r[3]] / sum(weight.values()) * len(rows) / sizes[r[3]]
        seed = f"{MIX_SEED}|{'' if r[0] is None else r[0]}|{hashlib.md5((r[1] or '').encode()).hexdigest() if r[1] is not None else ''}"
        u = int(hashlib.md5(seed.encode()).hexdigest()[:13], 16) / 2**52
        k, term, total = 0, math.exp(-mean), math.exp(-mean)
        while total <= u:
            k += 1
            term *= mean / k
            total += term
        found[r] += k
    return found


def test_stages_against_plain_code(spark):
    rows = fixture()
    docs, names, bag = spark.createDataFrame(rows, DOCS), [n for n, _ in corpus_pipeline.STAGES], lambda df: Counter(tuple(r) for r in df.collect())
    assert names == ["quality", "dedup", "secrets", "mix", "encode"]
    stage = dict(corpus_pipeline.STAGES)

    docs = stage["quality"](spark, docs, "")
    rows = [r for r in rows if r[1] is not None and passes(r[1])]
    assert bag(docs) == Counter(rows) and len(rows) > 80

    docs = stage["dedup"](spark, spark.createDataFrame(rows, DOCS), "")
    prints = dict(enumerate(brute_print(r[1]) for r in rows))
    groups = {}
    for k, top in brute_components(prints).items():
        groups.setdefault(top, []).append(rows[k])
    got = bag(docs)
    assert sum(got.values()) == len(groups) and set(got.values()) == {1}
    for group in groups.values():  # one row of each, that of the smallest id
        (kept,) = [r for r in group if r in got]
        assert kept[0] == min((r[0] for r in group if r[0] is not None), default=None)
    assert (7, prose(88, 55), "en", "src0", 2) in got and sum(r[0] is None for r in got) == 1
    rows = sorted(got, key=str)

    docs = stage["secrets"](spark, spark.createDataFrame(rows, DOCS), "")
    rows = [(r[0], new, r[2], r[3], r[4] if new == r[1] else len(new)) for r in rows for new in [redacted(r[1])]]
    assert bag(docs) == Counter(rows) and sum("[SECRET]" in r[1] for r in rows) == 1

    docs = stage["mix"](spark, spark.createDataFrame(rows, DOCS), "")
    want = +copies(rows)
    assert bag(docs) == want and docs.columns == [c.split()[0] for c in DOCS.split(", ")]

    rows = list(want.elements())
    known = reference_codec()
    docs = stage["encode"](spark, spark.createDataFrame(rows, DOCS), "")
    digest = lambda text: (len(known.encode_ordinary(text)), hashlib.sha256(np.array(known.encode_ordinary(text), "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert bag(docs) == Counter((r[0], *digest(r[1])) for r in rows)


def test_run_on_other_columns(spark, tmp_path):
    """Columns of the names that stages use inside, labels for some rows, and a null in every column."""
    names = ("text_hash", "blob", "_row", "copy", "ids", "kept", "quality", "h1")
    docs = spark.createDataFrame([*fixture(), (None,) * 5], DOCS)
    for name in names:
        docs = docs.withColumn(name, F.lit(name))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1) for k in range(60)] + [(None, 0), (0, None)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, f"file://{tmp_path}")
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 20
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, f"file://{tmp_path}")
        assert kept.columns == docs.columns
    assert kept.where(" AND ".join(f"{name} = '{name}'" for name in names)).count() == kept.count() == out.count()


def test_run_on_nothing(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0


def test_registry():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{k}" for k in range(1, 11)] and set(ORACLES) <= set(QUERIES)


def test_native_plans(spark, sf_dir):
    for name in ("op6_secret_scan", "op9_poisson_mix", "op10_license_dice"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow|Cartesian", plan)
