import json
import random

import pytest
from pyspark.sql import functions as F

from pagesieve.functions.redact import HIDDEN_KEYS
from pagesieve.operators import nested


def random_value(rng, depth):
    kind = rng.randrange(9 if depth else 6)
    if kind < 6:
        return [None, True, rng.randrange(-99, 99), rng.choice([1.5, -0.25]), rng.choice(["", "a\"b\\c", "né {x: [1, 2]}, ", "\t\n", "token=abc123 x"]), "plain"][kind]
    if kind == 6:
        return [random_value(rng, depth - 1) for _ in range(rng.randrange(4))]
    keys = rng.sample(["a", "b", "B", "é", "a b", "url", "note", "z.z", "\"q\"", "items"], rng.randrange(5))
    return {k: random_value(rng, depth - 1) for k in keys}


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    made = [random_value(rng, 4) for _ in range(150)] + [{}, [], [[]], {"a": {}}, [{"b": [[], {}]}], "x", 1, None]
    return [json.dumps(v, ensure_ascii=bool(i % 2), indent=2 if i % 3 == 0 else None) for i, v in enumerate(made)]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, text string")


def test_canonical_equals_sorted_keys(spark, texts):
    got = {r.id: r.canonical for r in nested.canonical(frame(spark, texts), "id", "text").collect()}
    assert got == {i: json.dumps(json.loads(t), sort_keys=True, ensure_ascii=False) for i, t in enumerate(texts)}


def test_values_equal_a_walk(spark, texts):
    def walk(v, path):
        kind = "object" if isinstance(v, dict) else "array" if isinstance(v, list) else "null" if v is None else "boolean" if isinstance(v, bool) else "integer" if isinstance(v, int) else "number" if isinstance(v, float) else "string"
        yield tuple(path), kind
        for k, x in v.items() if isinstance(v, dict) else enumerate(v) if isinstance(v, list) else ():
            yield from walk(x, [*path, k])

    got = sorted((r.id, [e.key if e.key is not None else e.idx for e in r.path], r.kind) for r in nested.values(frame(spark, texts), "id", "text").collect() if True for _ in [0])
    want = sorted((i, list(p), k) for i, t in enumerate(texts) for p, k in walk(json.loads(t), []))
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_fingerprints_ignore_the_order_of_keys(spark):
    a = '{"mode": "X", "fields": [{"name": "n", "at": {"b": 1, "a": [1, 2]}}], "config": {}}'
    b = '{"config":{},"fields":[{"at":{"a":[1,2],"b":1},"name":"n"}],"mode":"X"}'
    c = '{"config":{},"fields":[{"at":{"a":[2,1],"b":1},"name":"n"}],"mode":"X"}'
    got = {r.id: r.fingerprint for r in nested.fingerprints(frame(spark, [a, b, c, "no json", '{"a": 1, "a": 2}', None, ""]), "id", "text").collect()}
    assert set(got) == {0, 1, 2} and got[0] == got[1] != got[2]


def test_redaction_reaches_all_depths(spark, texts):
    import re

    def clean(text):
        return re.sub(r"(token=)\S+", r"\1[REDACTED_SECRET]", text)

    def walk(v, key=None):
        if key in HIDDEN_KEYS:
            return "[REDACTED]"
        if isinstance(v, dict):
            return {k: walk(x, k) for k, x in v.items()}
        if isinstance(v, list):
            return [walk(x) for x in v]
        if isinstance(v, str):
            return v.split("?")[0] + "?[URL_SANITIZED]" if key == "page_url" and "?" in v else clean(v)
        return v

    more = [
        {"a": [{"password": {"deep": [1, {"x": 2}]}, "ok": "token=abc123"}, ["token=zzz9", ["token=q1"]]], "secret": None, "last": 1}, {"token": [], "page_url": "https://h.com/a?b=1", "n": {"page_url": ["token=abc"]}},
        {"password": "x", "token": {"a": {"b": {}}}, "z": {"secret": [[1], [2]], "y": [True]}},
    ]
    every = [t for t in texts if "url" not in t] + [json.dumps(m) for m in more]
    got = {r.id: json.loads(r.redacted) for r in nested.redacted(frame(spark, every), "id", "text").collect()}
    assert got == {i: walk(json.loads(t)) for i, t in enumerate(every)}


def test_redaction_stays_in_the_row(spark):
    deep = '{"a": ' * 60 + '{"token": ' + "[" * 50 + '"x", {"secret": 1}' + "]" * 50 + ', "b": "token=abc123"}' + "}" * 60
    cases = {
        deep: '{"a":' * 60 + '{"token":"[REDACTED]","b":"token=[REDACTED_SECRET]"}' + "}" * 60,
        '{"pass\\u0077ord" : {"a": 1}, "x":"\\"password\\": {1}", "y" : [ ] , "secret": 5, "token": null }': '{"pass\\u0077ord":"[REDACTED]","x":"\\"password\\": {1}","y":[],"secret":"[REDACTED]","token":"[REDACTED]"}',
        '[{"token": {}}, {"token": [[], {}]}, "password", {"token":"a"}, -1.5e3]': '[{"token":"[REDACTED]"},{"token":"[REDACTED]"},"password",{"token":"[REDACTED]"},-1.5e3]',
        '"token=abc"': '"token=[REDACTED_SECRET]"', " [ ] ": "[]", "7": "7", '{"url": "https://h.com/a?b=1", "bearer": "x"}': '{"url":"https://h.com/a?[URL_SANITIZED]","bearer":"[REDACTED]"}',
    }
    rows = spark.createDataFrame([(i % 2, t, i) for i, t in enumerate([*cases, "no", None])], "id long, text string, other int")
    done = nested.redacted(rows, "id", "text", keep=("other",))
    assert [(r.id, r.redacted) for r in sorted(done.collect(), key=lambda r: r.other)] == [(i % 2, t) for i, t in enumerate(cases.values())]
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan and "Generate" not in plan


def test_schema_checks(spark):
    schema = spark.createDataFrame([
        ("", ["object"], True), ("kind", ["string"], True), ("score", ["number"], True), ("pages", ["integer", "null"], False), ("fields", ["array"], True), ("fields[]", ["object"], False),
        ("fields[].name", ["string"], True), ("fields[].samples", ["array"], False), ("fields[].samples[]", ["string"], False), ("meta", ["object"], False), ("meta.deep", ["object"], False), ("meta.deep.x", ["integer"], True),
    ], "path string, types array<string>, required boolean")
    replies = {
        '{"kind": "a", "score": 1, "fields": []}': [], '{"kind": "a", "score": 0.5, "pages": null, "fields": [{"name": "n", "samples": ["x"]}], "meta": {}}': [],
        '{"kind": 3, "fields": [{"samples": [1, "x"]}, {"name": null, "odd": {"more": 1}}, 7], "new": [1]}': [
            "extra: fields[1].odd", "extra: new", "missing: fields[0].name", "missing: score", "type: fields[0].samples[0] is integer, not string", "type: fields[1].name is null, not string", "type: fields[2] is integer, not object", "type: kind is integer, not string",
        ],
        "[]": ["type:  is array, not object"], "oops": ["not JSON"], '{"kind": "a", "score": 1, "fields": [], "meta": {"deep": {}}}': ["missing: meta.deep.x"],
        '{"kind": "a", "score": 1.5, "pages": 1.5, "fields": {}}': ["type: fields is object, not array", "type: pages is number, not integer|null"],
    }
    got = {r.id: r.errors for r in nested.violations(frame(spark, list(replies)), "id", "text", schema).collect()}
    assert got == dict(enumerate(replies.values()))
    assert nested.violations(frame(spark, ["{}"]).limit(0), "id", "text", schema).count() == 0


def test_violations_send_no_rows_to_the_driver(spark):
    """No join of values with values, whose smaller side would be broadcast when its compressed size is small."""
    texts = [json.dumps({"a": {"b": i}, "c": [{"d": "x"}, {}], "e": 1}) for i in range(400)] + ["no", None]
    schema = spark.createDataFrame([("", ["object"], True), ("a", ["object"], True), ("a.b", ["string"], True), ("c", ["array"], True), ("c[]", ["object"], False), ("c[].d", ["string"], True)], "path string, types array<string>, required boolean")
    done = nested.violations(frame(spark, texts), "id", "text", schema)
    got = {r.id: list(r.errors) for r in done.collect()}
    assert got == {i: ["extra: e", "missing: c[1].d", "type: a.b is integer, not string"] for i in range(400)} | {400: ["not JSON"], 401: ["not JSON"]}
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan
