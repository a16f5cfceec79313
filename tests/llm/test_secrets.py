import base64
import json

from pyspark.sql import functions as F

from pagesieve.llm.common import table
from pagesieve.llm.queries import QUERIES
from pagesieve.llm.secrets import confirmed_spans, is_key, scan
from tests.llm import brute


def der(tag, *parts):
    body = b"".join(parts)
    size = len(body).to_bytes(max(1, (len(body).bit_length() + 7) // 8), "big")
    return bytes([tag]) + (bytes([len(body)]) if len(body) < 128 else bytes([0x80 | len(size)]) + size) + body


RSA = der(0x30, der(2, b"\0"), *[der(2, bytes([7] * n)) for n in (64, 3, 64, 32, 32, 32, 32, 32)])
PKCS8 = der(0x30, der(2, b"\0"), der(0x30, der(6, b"+ep")), der(4, der(4, b"k" * 32)))
TOKEN = ".".join(base64.urlsafe_b64encode(x).decode().rstrip("=") for x in (json.dumps({"alg": "HS256", "typ": "JWT"}).encode(), b'{"sub":"1"}', b"s" * 32))


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    texts = [tuple(r) for r in table(spark, folder, "documents").select("doc_id", "text").collect()]
    got = {r.doc_id: tuple(r)[1:5] for r in QUERIES["op7_confirmed_secrets"](spark, folder).collect()}
    assert got == {d: brute.base_secrets(t) for d, t in texts}
    assert any(v[0] for v in got.values())


def test_structure_is_confirmed():
    assert is_key(RSA) and is_key(PKCS8) and not is_key(RSA[:-1]) and not is_key(RSA + b"\0")
    for data in (RSA, PKCS8):
        text = f"x {base64.b64encode(data).decode()} y"
        assert confirmed_spans(text) == [("key", 2, len(text) - 2)]
        assert confirmed_spans(data.hex()) == [("key", 0, len(data.hex()))]
    pem = "-----BEGIN RSA PRIVATE KEY-----\n" + base64.encodebytes(RSA).decode() + "-----END RSA PRIVATE KEY-----"
    assert ("pem", 3, 3 + len(pem)) in confirmed_spans("né " + pem)
    assert confirmed_spans(f"t {TOKEN} z") == [("jwt", 2, 2 + len(TOKEN))]
    fake = base64.urlsafe_b64encode(b'{"typ":"JWT"}').decode().rstrip("=")
    assert confirmed_spans(f"{fake}.abcd.efgh " + "A" * 64 + " " + "ab12" * 16) == []


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "é PASSWORD: 'abcdefgh' token=short ſecret=12345678 api_key=\"token=abcdefgh12\""), (4, "AKIA" + "A" * 12 + " AKIAAAAA " + "f" * 31 + " " + "0" * 32), (None, "x"), (4, "q" * 300_000 + " secret = " + "0a" * 20), (4, TOKEN)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit(1)).withColumn("id", F.lit(1))
    got = scan(docs).collect()
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(((d, *brute.base_secrets(t)) for d, t in rows), key=repr)
    assert [r.spans for r in got if r.doc_id == 4][-1] == f"jwt:0:{len(TOKEN)}"
    assert scan(docs.limit(0)).count() == 0
