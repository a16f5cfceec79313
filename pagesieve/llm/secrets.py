"""Secret scans with structural confirmation.

Base patterns (assignments, access keys, long hex runs) report spans as they
stand.  Further candidates, base64, base64url or hex runs, are decoded and only
reported when their structure holds: DER key encodings whose nested lengths fill
the data exactly, OpenSSH key containers, and signed tokens whose header is a
JSON object naming an algorithm.

Defined results: null is an empty text; repeated rows give one row each; an
empty table gives no rows; other columns are ignored, whatever their names.
Offsets count code points, ends are exclusive.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # runs are maximal, so shorter ones need not be looked at
HINTS = ("passw", "secret", "token", "api")
BASE_KINDS, MORE_KINDS = ("assign", "access", "hex"), ("jwt", "key", "pem")
# '{' followed by a quote or a blank starts with ew or ey in base64
JWT = re.compile(r"(?<![A-Za-z0-9_-])(e[wy][A-Za-z0-9_-]{6,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]*)")
RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}={0,2}")
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----([A-Za-z0-9+/=\s]+)-----END \1-----")
OPENSSH = b"openssh-key-v1\x00"


def decoded(run: str) -> list[bytes]:
    """The readings of a candidate as hex, base64 or base64url."""
    out = []
    if len(run) % 2 == 0 and re.fullmatch(r"[0-9A-Fa-f]+", run):
        out.append(bytes.fromhex(run))
    bare = run.rstrip("=").replace("-", "+").replace("_", "/")
    if len(bare) % 4 != 1:
        try:
            out.append(base64.b64decode(bare + "=" * (-len(bare) % 4), validate=True))
        except binascii.Error:
            pass
    return out


def der_items(data: bytes) -> list[tuple[int, bytes]] | None:
    """Tags and contents that fill ``data`` exactly; None if a length does not fit."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, size = data[at], data[at + 1]
        at += 2
        if size >= 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > len(data):
                return None
            size = int.from_bytes(data[at : at + n], "big")
            at += n
        if at + size > len(data):
            return None
        out.append((tag, data[at : at + size]))
        at += size
    return out


def is_key(data: bytes) -> bool:
    """RSA, EC, PKCS#8 and encrypted private keys, or an OpenSSH key container."""
    if data.startswith(OPENSSH):
        size = int.from_bytes(data[15:19], "big")
        return 0 < size < len(data) - 19 and data[19 : 19 + size].isascii()
    top = der_items(data)
    if not top or len(top) != 1 or top[0][0] != 0x30 or not (inner := der_items(top[0][1])):
        return False
    tags = [t for t, _ in inner]
    if tags[0] == 0x02 and len(inner[0][1]) == 1:  # a version comes first
        if len(tags) >= 9 and set(tags[:9]) == {0x02}:
            return True  # RSA: version and eight integers
        if tags[1:3] == [0x30, 0x04]:
            return der_items(inner[1][1]) is not None  # PKCS#8: algorithm, octets
        return tags[1] == 0x04 if len(tags) > 1 else False  # EC: octets, then optional parts
    if tags == [0x30, 0x04]:  # encrypted PKCS#8
        parts = der_items(inner[0][1])
        return bool(parts) and parts[0][0] == 0x06
    return False


def is_token(header: str) -> bool:
    for data in decoded(header):
        try:
            if isinstance(head := json.loads(data), dict) and isinstance(head.get("alg"), str):
                return True
        except (ValueError, RecursionError):
            pass
    return False


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = []
    low = text.lower()
    if any(h in low for h in HINTS):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    return out + [("hex", *m.span()) for m in HEX.finditer(text)]


def confirmed_spans(text: str) -> list[tuple[str, int, int]]:
    out = []
    if "." in text and "e" in text:
        out += [("jwt", *m.span()) for m in JWT.finditer(text) if is_token(m[1])]
    if "-----BEGIN" in text:
        out += [("pem", *m.span()) for m in PEM.finditer(text) if any(map(is_key, decoded(re.sub(r"\s", "", m[2]))))]
    return out + [("key", *m.span()) for m in RUN.finditer(text) if any(map(is_key, decoded(m[0])))]


def joined(spans: list[tuple[str, int, int]]) -> str:
    order = BASE_KINDS + MORE_KINDS
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], order.index(x[0]), x[2])))


def _scan(batches):
    for batch in batches:
        rows = []
        for text in batch.column(1):
            text = text.as_py() or ""
            base = base_spans(text)
            more = confirmed_spans(text)
            kinds = [k for k, _, _ in base]
            rows.append((*(kinds.count(k) for k in BASE_KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more)))
        columns = list(zip(*rows, strict=True)) if rows else [()] * 5
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.record_batch([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: counts by base kind, digest of the base spans, and all confirmed ``spans``."""
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {dict(slim.dtypes)['id']}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return slim.mapInArrow(_scan, schema).withColumnRenamed("id", id_col)
