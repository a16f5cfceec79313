import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from pagesieve.llm.common import table
from pagesieve.llm import langid
from pagesieve.llm.langid import learn, predict, viterbi
from pagesieve.llm.queries import QUERIES
from pagesieve.llm.tokens import words
from tests.llm.brute import low


def test_viterbi_equals_all_paths():
    rng = np.random.default_rng(3)
    offsets = np.array([0, 5, 5, 6, 10])
    scores = np.round(rng.normal(size=(10, 3)) * 3, 2)
    label = viterbi(scores, offsets, 1.7)
    worth = lambda s, path: sum(s[i, p] for i, p in enumerate(path)) - 1.7 * sum(a != b for a, b in itertools.pairwise(path))
    for a, b in itertools.pairwise(offsets):
        if b > a:
            own = scores[a:b]
            assert np.isclose(worth(own, label[a:b]), max(worth(own, p) for p in itertools.product(range(3), repeat=b - a)))


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    got = QUERIES["op8_viterbi_language"](spark, folder).join(table(spark, folder, "documents").select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL")
    right, n = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert n > 200 and right > 0.97


def test_mixed_and_odd_rows(spark):
    rng = random.Random(1)
    en, ru, de = ["the", "of", "thing", "water", "when"], ["вода", "когда", "это", "не", "дом"], ["der", "über", "wasser", "wenn", "nicht"]
    text = lambda words, n: " ".join(rng.choice(words) for _ in range(n))
    train = [(lang, text(w, 60)) for lang, w in (("en", en), ("ru", ru), ("de", de)) for _ in range(30)] + [(None, "zzz"), ("en", None)]
    model = learn(spark.createDataFrame(train, "lang string, text string"))
    assert model.langs == ["de", "en", "ru"]
    a, b = text(en, 12), text(ru, 15)
    rows = [(1, a), (2, a + ". " + b), (3, None), (4, ""), (5, "12 … — 😀"), (None, b), (6, "漢字"), (7, text(de, 40_000)), (7, a), (7, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("xx")).withColumn("score", F.lit("?"))
    got = predict(docs, model).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert [by[i].lang_pred for i in (1, 2, 3, 4, 5, None, 7)] == ["en", "ru", "und", "und", "und", "ru", "en"]
    assert sorted(r.lang_pred for r in got if r.doc_id == 7) == ["de", "en", "en"]
    assert by[6].lang_pred in model.langs and by[6].score == 0
    assert [tuple(s) for s in by[2].spans] == [("en", 0, len(a)), ("ru", len(a) + 2, len(a) + 2 + len(b))]
    assert predict(docs.limit(0), model).count() == 0
    empty = learn(spark.createDataFrame([], "lang string, text string"))
    assert {r.lang_pred for r in predict(docs, empty).collect()} == {"und"}


def plain_prediction(text, model):
    """Label and score of a text, word by word in plain Python."""
    found = [w for w in re.split(rb"[^\x80-\xffa-z]+", low(text).encode()) if w]
    if not found or not any(map(str.isalpha, text)):
        return langid.UNDETERMINED, 0.0
    rows, sizes = [], []
    for w in found:
        padded = b" " + w + b" "
        grams = [((a << 16 | b << 8 | c) * 2654435761 & 0xFFFFFFFF) >> 17 for a, b, c in zip(padded, padded[1:], padded[2:])]
        word = int(next(words(pa.array([w.decode(errors="ignore")]), langid.LETTERS)).hashes[0] >> np.uint64(40)) & (langid.WORDS - 1)
        script = max(next((langid._NAMES.index(n) + 1 for n, a, z in langid.SCRIPTS if a <= b <= z), 0) for b in w)
        usable = [bool(x) for x in model.written[script]]
        telling = any(usable) and script > 0
        own = [sum(float(lang[g]) for g in grams) + float(lang[langid.TRIGRAMS + word]) for lang in model.weights]
        rows.append([0.0] * len(own) if not telling else [s if u else -1e6 for s, u in zip(own, usable)])
        sizes.append(len(w) if telling else 0)
    best, back = list(rows[0]), []
    for row in rows[1:]:
        top = max(range(len(best)), key=lambda i: best[i])
        back.append([i if best[i] >= best[top] - model.penalty else top for i in range(len(best))])
        best = [max(best[i], best[top] - model.penalty) + row[i] for i in range(len(best))]
    label = [max(range(len(best)), key=lambda i: best[i])]
    for step in reversed(back):
        label.append(step[label[-1]])
    letters = [sum(n for l, n in zip(reversed(label), sizes) if l == i) for i in range(len(best))]
    own = max(range(len(best)), key=lambda i: letters[i]) if sum(letters) else model.prior
    total = [sum(r[i] for r in rows) for i in range(len(best))]
    odds = [math.exp(max(t - max(total), -700)) for t in total]
    score = letters[own] / max(sum(letters), 1) * max(odds[own] / sum(odds), 1 / len(odds)) if sum(letters) else 0.0
    return model.langs[own], score


def test_predictions_equal_plain_ones(spark, folder):
    docs = table(spark, folder, "documents")
    model = learn(docs.where("doc_id % 2 = 0"))
    rows = [(r.doc_id, r.text) for r in docs.where("doc_id % 2 = 1 AND length(text) < 3000").limit(60).collect()]
    rows += [(10**6 + i, rows[i][1][:200] + "\n" + rows[i + 20][1][:300]) for i in range(15)] + [(-1, "12 ..."), (-2, "\u0432\u043e\u0434\u0430"), (-3, "THE the Wasser"), (-4, "")]
    got = {r.doc_id: (r.lang_pred, r.score) for r in predict(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    for d, text in rows:
        want = plain_prediction(text, model)
        assert got[d][0] == want[0] and abs(got[d][1] - want[1]) < 1e-4, (d, got[d], want)
