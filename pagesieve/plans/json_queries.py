"""Nested JSON queries: fingerprints, redaction at any depth, schema checks of model replies."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagesieve.functions import redact
from pagesieve.operators import nested
from pagesieve.plans.registry import query
from pagesieve.sources.tables import load


def _filled(shape: str, **parts):
    """A text with ``<name>`` replaced by columns."""
    text = F.lit(shape)
    for name, column in parts.items():
        text = F.replace(text, F.lit(f"<{name}>"), column.cast("string"))
    return text


# The same spec with its keys in three orders; the third differs in the order of a list for every other event.
_SPECS = (
    '{"mode": "<kind>", "config": {}, "fields": [{"name": "f<user>", "at": {"y": [1, {"b": <k>, "a": null}], "x": true}}, <k>]}',
    '{"fields":[{"at":{"x":true,"y":[1,{"a":null,"b":<k>}]},"name":"f<user>"},<k>],"config":{},"mode":"<kind>"}',
    '{ "config" : { } ,\n "fields" : [ { "name" : "f<user>" , "at" : { "y" : [ <one> , { "a" : null , "b" : <k> } ] , "x" : true } } , <k> ] , "mode" : "<kind>" }',
)


@query(
    "json_fingerprint",
    """SELECT event_id, sha256('{"config": {}, "fields": [{"at": {"x": true, "y": [' || CASE WHEN event_id % 6 = 5 THEN 2 ELSE 1 END || ', {"a": null, "b": ' || (props->>'k') || '}]}, "name": "f' || user_id || '"}, '
              || (props->>'k') || '], "mode": "' || event_type || '"}') AS fingerprint FROM events""",
)
def json_fingerprint(spark, folder):
    """One fingerprint for a spec whatever the order of its keys, at any depth."""
    shape = F.get(F.array(*map(F.lit, _SPECS)), (F.col("event_id") % 3).cast("int"))
    text, one = shape, F.when(F.col("event_id") % 6 == 5, "2").otherwise("1")
    for name, column in (("kind", F.col("event_type")), ("user", F.col("user_id").cast("string")), ("k", F.get_json_object("props", "$.k")), ("one", one)):
        text = F.replace(text, F.lit(f"<{name}>"), column)
    rows = load(spark, folder, "events").select("event_id", text.alias("text"))
    return nested.fingerprints(rows, "event_id", "text").withColumnRenamed("id", "event_id")


_LOGGED = '{"props": <props>, "auth": [{"password": {"old": [1, {"x": "<kind>"}], "new": null}, "user": <user>}, "Bearer abcdefgh123", ["token=abc<user>", "plain <kind>"]], "page_url": "https://h.com/<kind>?id=<user>", "secret": <k>, "after": [{}, []]}'


@query(
    "redact_nested",
    """SELECT event_id, '{"props":{"k":' || (props->>'k') || '},"auth":[{"password":"[REDACTED]","user":' || user_id || '},"Bearer [REDACTED_SECRET]",["token=[REDACTED_SECRET]","plain ' || event_type
              || '"]],"page_url":"https://h.com/' || event_type || '?[URL_SANITIZED]","secret":"[REDACTED]","after":[{},[]]}' AS redacted,
              'token=[REDACTED_SECRET]|' || event_type || '|https://h.com/a?[URL_SANITIZED]' AS cleaned FROM events""",
)
def redact_nested(spark, folder):
    """Hidden keys, address keys and free text inside nested maps and lists, and a plain list."""
    text = _filled(_LOGGED, props=F.concat(F.lit('{"k": '), F.get_json_object("props", "$.k"), F.lit("}")), kind=F.col("event_type"), user=F.col("user_id"), k=F.get_json_object("props", "$.k"))
    # redaction takes far longer than reading: the short rows are dealt over all tasks before the texts are made
    events = load(spark, folder, "events").where("event_id IS NOT NULL").select("event_id", "event_type", "user_id", "props").repartition("event_id")
    plain = F.array_join(redact.clean_list(F.array(F.concat(F.lit("token="), F.col("user_id").cast("string")), F.col("event_type"), F.lit("https://h.com/a?b=c"))), "|")
    rows = events.select("event_id", text.alias("text"), plain.alias("cleaned"))
    return nested.redacted(rows, "event_id", "text", keep=("cleaned",)).withColumnRenamed("id", "event_id")


_REPLY_SCHEMA = (
    ("", ("object",), True), ("page_type", ("string",), True), ("confidence", ("number",), True), ("estimated_pages", ("integer", "null"), False),
    ("candidate_fields", ("array",), True), ("candidate_fields[]", ("object",), False), ("candidate_fields[].name", ("string",), True), ("candidate_fields[].selector", ("string",), True),
    ("candidate_fields[].sample_values", ("array",), False), ("candidate_fields[].sample_values[]", ("string",), False),
)
_REPLIES = (
    '```json\n{"page_type": "<kind>", "confidence": 0.<k>, "candidate_fields": [{"name": "n", "selector": ".a", "sample_values": ["<k>"]}]}\n```',
    'Sure: {"confidence": 1, "estimated_pages": null, "candidate_fields": [{"name": <k>}, {"selector": "a", "name": "x", "odd": {"deep": 1}}]}',
    '{"page_type": ["<kind>"], "confidence": "high", "estimated_pages": 1.5, "candidate_fields": {}, "more": <k>}',
    '{"page_type": "<kind>", "confidence": 0.5, "candidate_fields": [{"name": "n", "selector": "s", "sample_values": ["a", <k>, null]}, 7]}',
    "nothing here",
)


@query(
    "model_reply_errors",
    """SELECT event_id, CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'extra: candidate_fields[1].odd|missing: candidate_fields[0].selector|missing: page_type|type: candidate_fields[0].name is integer, not string'
              WHEN 2 THEN 'extra: more|type: candidate_fields is object, not array|type: confidence is string, not number|type: estimated_pages is number, not integer|null|type: page_type is array, not string'
              WHEN 3 THEN 'type: candidate_fields[0].sample_values[1] is integer, not string|type: candidate_fields[0].sample_values[2] is null, not string|type: candidate_fields[1] is integer, not object'
              ELSE 'not JSON' END AS errors, event_id % 5 = 0 AS valid FROM events""",
)
def model_reply_errors(spark, folder):
    """Replies against a schema table: missing, ill-typed and unknown members, and no JSON at all."""
    shape = F.get(F.array(*map(F.lit, _REPLIES)), (F.col("event_id") % 5).cast("int"))
    text = F.replace(F.replace(shape, F.lit("<kind>"), F.col("event_type")), F.lit("<k>"), F.get_json_object("props", "$.k"))
    schema = spark.createDataFrame([(p, list(t), r) for p, t, r in _REPLY_SCHEMA], "path string, types array<string>, required boolean")
    rows = load(spark, folder, "events").select("event_id", redact.json_payload(text).alias("payload"))
    done = nested.violations(rows, "event_id", "payload", schema)
    return done.select(F.col("id").alias("event_id"), F.array_join("errors", "|").alias("errors"), (F.size("errors") == 0).alias("valid"))
