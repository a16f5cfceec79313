from pyspark.sql import functions as F

import corpus_pipeline as pipe
from pagesieve.llm import mixing
from pagesieve.llm.common import table
from tests.llm import brute

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_one_by_one(spark, tmp_path):
    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents")
    kept = []
    for i, (_, stage) in enumerate(pipe.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        kept.append({r.doc_id: r for r in docs.collect()})
        assert docs.columns[:5] == COLUMNS and docs.count() == len(kept[-1])
    language, near, clean, mixed, dealt = kept
    assert 900 < len(language) <= 1000
    pairs = [(d, r.text) for d, r in language.items()]
    assert set(near) == {d for d, _, c in brute.similar_components(pairs, 5, 80) if d == c}
    items = [tuple(r) for r in table(spark, sf, "benchmark").collect()]
    hit = brute.contamination([(d, r.text) for d, r in near.items()], items)
    assert set(clean) == {d for (d, _), v in hit.items() if not v[-1]} and len(clean) < len(near)
    assert 0.2 * len(clean) < len(mixed) < 0.8 * len(clean) and set(mixed) <= set(clean)
    assert all(tuple(dealt[d])[:5] == tuple(mixed[d]) for d in mixed) and len(dealt) == len(mixed)
    assert len({(r.shard_no, r.slot) for r in dealt.values()}) == len(dealt)


def test_odd_rows(spark, folder):
    text = "Thing of the water that was here when the others came " * 3
    rows = [(1, text, "en", "a", 1), (1, text, "en", "a", 1), (None, text, "en", "a", 1), (None, text + " x", "en", "a", 1), (5, None, None, None, None), (6, "", "en", "a", 0), (7, "something else of quite another kind is said here by nobody", "en", "b", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    language = pipe.identify_language(spark, docs, folder)
    assert sorted(r.doc_id or 0 for r in language.collect()) == [0, 0, 1, 1, 7]
    near = pipe.drop_near_duplicates(spark, language, folder)
    assert sorted(r.doc_id for r in near.collect()) == [1, 7]
    nameless = pipe.drop_near_duplicates(spark, docs.where("doc_id IS NULL"), folder)
    assert nameless.count() == 1
    assert pipe.drop_benchmark_passages(spark, near, folder).count() == 2
    for _, stage in pipe.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0


def test_mixing_goes_by_the_told_language(spark, tmp_path):
    """A clean document without a language column value is mixed like others of the language it is told to have."""
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    nameless = F.when(F.col("doc_id") % 3 == 0, F.col("lang"))
    language = pipe.identify_language(spark, docs.withColumn("lang", nameless), "")
    language.write.parquet(str(tmp_path / "language"))
    language = spark.read.parquet(str(tmp_path / "language"))
    assert language.count() > 900 and language.where("lang IS NULL").count() > 500
    mixed = pipe.mix_sources(spark, language, "")
    assert mixed.columns == docs.columns
    told = {r.doc_id: r[pipe.TOLD] for r in language.collect()}
    plain = mixing.measured(language.withColumn("lang", F.col(pipe.TOLD)), mixing.PRODUCTION)
    want = {r.row.doc_id for r in mixing.mix(plain, mixing.calibrate(plain, mixing.PRODUCTION, mixing.BUDGET)).where("sampled").collect()}
    got = mixed.collect()
    assert {r.doc_id for r in got} == want and sum(r.lang is None for r in got) > 200
    assert len({told[r.doc_id] for r in got if r.lang is None}) == 4


def test_clean_texts_of_several_languages_stay(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    by = {}
    for r in docs.where("length(text) > 600").orderBy("doc_id").collect():
        by.setdefault(r.lang, []).append(r.text)
    part = lambda lang, i, n: by[lang][i % len(by[lang])][:n]
    mixed = []
    for i in range(40):
        mixed.append(part("en", i, 520) + "\n" + part("de", i, 480))
        mixed.append(part("fr", i, 300) + "\n" + part("en", i, 520) + "\n" + part("fr", i + 1, 180))
        mixed.append("\n".join(part(lang, i, 300) for lang in ("en", "de", "fr", "es")))
    extra = spark.createDataFrame([(10**6 + i, t, None, "src1", len(t)) for i, t in enumerate(mixed)], docs.schema)
    kept = pipe.identify_language(spark, docs.union(extra), "")
    assert kept.where(f"doc_id >= {10**6}").count() == len(mixed)
    rejected = spark.createDataFrame([(1, "12 34 -", None, "a", 7), (2, "\u6f22\u5b57 \u6f22\u5b57", None, "a", 5)], docs.schema)
    assert pipe.identify_language(spark, docs.where("doc_id > 2").union(rejected), "").where("doc_id <= 2").count() == 0


def test_clashing_and_odd_names_and_long_texts(spark, tmp_path):
    """Every stage, with names that its helpers have, repeated rows that differ in them, and a very long text."""
    docs = table(spark, "/root/testdata/sf0.01", "documents").limit(300)
    names = ["slot", "shard_no", "Shard", "row_hash", "r_id", "r_hash", "told_lang", pipe.TOLD, "a.b", "row", "own_id", "Their_Hash", "u", "tokens", "told", "bucket", "maybe"]
    docs = docs.select("*", *(F.concat(F.lit(f"{n}="), F.col("doc_id")).alias(n) for n in names))
    long = docs.where("doc_id = 2").withColumn("doc_id", F.lit(7_000_000).cast("long")).withColumn("text", F.concat_ws("\n", F.transform(F.sequence(F.lit(1), F.lit(4000)), lambda i: F.concat(F.lit("Another line of the long text is number "), i.cast("string")))))
    docs = docs.union(docs.where("doc_id < 40").withColumn("slot", F.lit("again"))).union(long)
    columns = docs.columns
    for i, (name, stage) in enumerate(pipe.STAGES):
        out = stage(spark, docs, "/root/testdata/sf0.01")
        assert out.columns[: len(columns)] == columns, name
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        rows = docs.collect()
        assert rows and all(r[n] in (f"{n}={r.doc_id}", "again", f"{n}=2") for r in rows for n in names)
        if name == "near_duplicates":
            assert len({r.doc_id for r in rows}) == len(rows)
            assert any(r.doc_id == 7_000_000 and len(r.text) > 100_000 for r in rows)
    assert docs.columns[-2:] == ["shard_no_2", "slot_2"]
    dealt = sorted((r.shard_no_2, r.slot_2) for r in rows)
    assert len(set(dealt)) == len(rows)


def test_a_corpus_without_languages_stays_whole(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents").withColumn("lang", F.lit(None).cast("string"))
    kept = pipe.identify_language(spark, docs, "")
    assert kept.count() == docs.count() and kept.where(f"{pipe.TOLD} IS NOT NULL").count() == 0
    assert 0 < pipe.mix_sources(spark, kept, "").count() < docs.count()
