import re
import struct
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from pagesieve.llm.mixing import BUDGET, PRODUCTION, PROSE, REST, SEED, TOPICS, Targets, calibrate, measured, mix, probabilities, rake
from pagesieve.llm.queries import QUERIES


def test_raking_meets_the_marginals_and_keeps_interactions():
    rng = np.random.default_rng(1)
    present = rng.uniform(1, 100, (4, 3, 2))
    shares = [np.array(s) for s in ([0.4, 0.3, 0.2, 0.1], [0.5, 0.25, 0.25], [0.9, 0.1])]
    cells = rake(present, shares)
    for axis, share in enumerate(shares):
        assert np.allclose(cells.sum(tuple(i for i in range(3) if i != axis)), share)
    odds = lambda x: x[0, 0, 0] * x[1, 1, 0] / (x[0, 1, 0] * x[1, 0, 0])
    assert np.isclose(odds(cells), odds(present))
    _, chance = probabilities(present, cells, 0.3)
    assert np.isclose((chance * present).sum(), 0.3 * present.sum()) and chance.max() <= 1


def test_query(spark):
    rows = QUERIES["op10_raked_mix"](spark, "/root/testdata/sf0.01")
    total, chosen, expected, n, ids = rows.agg(F.sum("n_tokens"), F.sum(F.when(F.col("sampled"), F.col("n_tokens"))), F.sum(F.col("n_tokens") * F.col("probability")), F.count("*"), F.countDistinct("doc_id")).first()
    assert n == ids == 1000 and abs(expected - BUDGET * total) < 1e-6 * total and abs(chosen - expected) < 0.15 * expected
    texts = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", F.size(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))).alias("w"))
    assert rows.join(texts, "doc_id").where("n_tokens <> w").count() == 0


def test_expected_shares(spark):
    rows = [(i, "w " * (1 + i % 7), f"s{min(i % 5, 2)}", ("en", "de")[i % 3 == 0], None) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, topic string").withColumn("tokens", F.lit("theirs")).withColumn("u", F.lit(2))
    targets = Targets({"s0": 0.5, "s1": 0.3}, {"en": 0.4, "de": 0.6, "xx": 0.5}, {})
    slim = measured(docs, targets, topic=F.col("topic"))
    out = mix(slim, calibrate(slim, targets, 0.2))
    share = {r.source: r.t for r in out.groupBy("source").agg(F.sum(F.col("tokens") * F.col("probability")).alias("t")).collect()}
    assert all(np.isclose(share[k] / sum(share.values()), v) for k, v in {"s0": 0.5, "s1": 0.3, REST: 0.2}.items())
    german = out.agg(F.sum(F.when(F.col("lang") == "de", F.col("tokens") * F.col("probability"))) / F.sum(F.col("tokens") * F.col("probability"))).first()[0]
    assert np.isclose(german, 0.6)  # the language without tokens is left out
    assert out.select("row.*").columns == docs.columns


def test_odd_rows(spark):
    rows = [(1, None, None, None), (2, "", "src0", "en"), (None, "a b", "src0", "en"), (None, "a b", "src0", "en"), (3, "x " * 300_000, "nowhere", "??"), (4, "Licensed", "src1", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    slim = measured(docs, PRODUCTION)
    out = mix(slim, calibrate(slim, PRODUCTION, 0.5)).collect()
    assert sorted(r.tokens for r in out) == [0, 0, 1, 2, 2, 300_000] and all(0 <= r.probability <= 1 for r in out)
    assert len({r.sampled for r in out if r.row.doc_id is None}) == 1
    for few in (docs.limit(0), docs.where("doc_id = 1")):
        none = measured(few, PRODUCTION)
        assert mix(none, calibrate(none, PRODUCTION, 0.5)).where("sampled").count() == 0


def test_unlisted_languages_are_mixed_too(spark):
    """Targets that sum to 1 leave null and unlisted languages their present share."""
    lang = ("en", "de", "fr", "es", None, "it")
    rows = [(i, f"w{i} " * 10, f"src{i % 20}", lang[i % 6]) for i in range(6000)]
    docs = measured(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"), PRODUCTION)
    out = mix(docs, calibrate(docs, PRODUCTION, 0.5))
    want = {r.lang: r.n for r in out.groupBy("lang").agg(F.sum(F.col("tokens") * F.col("weight")).alias("n")).collect()}
    assert np.isclose(want[REST] / sum(want.values()), 1 / 3) and np.isclose(want["en"] / sum(want.values()), 0.5 * 2 / 3)
    kept = out.where("sampled").groupBy("row.lang").count().collect()
    assert {r.lang for r in kept} == set(lang) and all(r["count"] > 100 for r in kept)


def test_query_equals_a_plain_version(spark):
    """Cells, weights, probabilities and draws of the whole table, by loops over cells and a checksum library."""
    folder = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text or "", r.source, r.lang) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    axes = [dict(a) for a in (PRODUCTION.source, PRODUCTION.lang, PRODUCTION.topic)]
    listed = lambda v, axis: v if v in axis else REST
    cell, tokens = {}, {}
    for d, text, source, lang in docs:
        topic = next((t for t, p in TOPICS.items() if re.search(p, text)), PROSE)
        cell[d] = (listed(source, axes[0]), listed(lang, axes[1]), listed(topic, axes[2]))
        tokens[d] = len(re.findall(r"[^\x20\x09-\x0D]+", text))
    total = sum(tokens.values())
    present = Counter()
    for d in cell:
        present[cell[d]] += tokens[d] / total
    wanted = []
    for i, axis in enumerate(axes):
        own = Counter()
        for c, p in present.items():
            own[c[i]] += p
        share = {v: s for v, s in axis.items() if own[v] > 0}
        left = max(0.0, 1 - sum(axis.values()))
        left = own[REST] if left < 1e-9 else left
        scale = (1 - left) / sum(share.values()) if own[REST] > 0 and 1 - sum(axis.values()) < 1e-9 else 1
        share = {v: s * scale for v, s in share.items()} | ({REST: left} if own[REST] > 0 else {})
        wanted.append({v: s / sum(share.values()) for v, s in share.items()})
    raked = dict(present)
    for _ in range(3000):
        for i, share in enumerate(wanted):
            own = Counter()
            for c, p in raked.items():
                own[c[i]] += p
            raked = {c: p * share[c[i]] / own[c[i]] if own[c[i]] else 0.0 for c, p in raked.items()}
    weight = {c: raked[c] / p for c, p in present.items() if p}
    low, high = 0.0, 1e6
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if sum(min(1, middle * weight[c]) * p for c, p in present.items() if p) < BUDGET else (low, middle)
    got = QUERIES["op10_raked_mix"](spark, folder).collect()
    assert len(got) == len(docs)
    text = {d: t for d, t, _, _ in docs}
    for r in got:
        c = (r.source, r.lang, r.topic)
        assert c == cell[r.doc_id] and r.n_tokens == tokens[r.doc_id]
        chance = min(1.0, high * weight.get(c, 0.0))
        assert abs(r.probability - chance) < 1e-6
        draw = xxhash.xxh64_intdigest(text[r.doc_id].encode(), xxhash.xxh64_intdigest(struct.pack("<q", r.doc_id), xxhash.xxh64_intdigest(struct.pack("<i", SEED), 42)))
        draw = (draw - 2**64 if draw >> 63 else draw) % (1 << 53) / (1 << 53)
        assert r.sampled == (draw < r.probability)
