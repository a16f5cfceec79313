"""Secret redaction over text, maps and arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagesieve.functions.urls import SANITIZED_QUERY, any_of, sanitize_url

REDACTED = "[REDACTED]"
REDACTED_SECRET = "[REDACTED_SECRET]"

# Keys hidden whole, and keys that hold addresses.
HIDDEN_KEYS = (
    "api_key", "token", "access_token", "refresh_token", "authorization", "password", "secret",
    "bearer", "hashed_password", "api_key_encrypted",
)
URL_KEYS = (
    "url", "normalized_url", "source_url", "seed", "seed_validated", "validated_url",
    "validated_seed", "final_url", "redirect_url", "page_url", "root_url",
)

# Shapes of credentials in free text.
BEARER = r"(?i)(bearer\s+)[A-Za-z0-9._~+/=-]{8,}"
KEY_VALUE = (
    r"(?i)((?:api[_-]?key|x-api-key|authorization|password|token|access_token|refresh_token|secret"
    r"|hashed_password|api_key_encrypted)\s*[:=]\s*)[^\s,;]+"
)
#: Every name of a key in ``KEY_VALUE`` holds one of these.
KEY_WORDS = ("api", "authorization", "password", "token", "secret")
SK_KEY = r"\bsk-[A-Za-z0-9_-]{6,}\b"


def hide_secrets(text: Column, known: tuple[str, ...] = ()) -> Column:
    """Replace credential shapes, and any known secret of four characters or more."""
    out = text
    for secret in known:
        if len(secret) >= 4:
            out = F.replace(out, F.lit(secret), F.lit(REDACTED_SECRET))
    # most texts hold none of the words: a plain search spares them the patterns
    for shape, words in ((BEARER, ("bearer",)), (KEY_VALUE, KEY_WORDS)):
        worth = any_of(F.contains(F.lower(text), F.lit(w)) for w in words)
        hidden = F.regexp_replace(out, shape, "$1" + REDACTED_SECRET.replace("[", r"\[").replace("]", r"\]"))
        out = F.when(worth, hidden).otherwise(out)
    return F.when(F.contains(text, F.lit("sk-")), F.regexp_replace(out, SK_KEY, REDACTED_SECRET)).otherwise(out)


def hide_url_queries(text: Column) -> Column:
    """Cut query and fragment from every http(s) address inside free text."""
    address = r"(https?)://([^\s\"')\]/?#;]*)([^\s\"')\]?#;]*)"
    params = r"(?:;[^\s\"')\]/?#]*)?"
    tail = r"(?:[?#][^\s\"')\]]+)"
    marked = F.regexp_replace(text, address + params + tail, "$1://$2$3?" + SANITIZED_QUERY)
    return F.regexp_replace(marked, address + params + r"[?#](?=[\s\"')\]]|$)", "$1://$2$3")


def clean_text(text: Column) -> Column:
    return hide_secrets(hide_url_queries(text))


def clean_map(values: Column) -> Column:
    """Redact a map<string,string>: whole values, addresses, then free text."""
    return F.transform_values(
        values,
        lambda k, v: F.when(k.isin(*HIDDEN_KEYS), F.lit(REDACTED))
        .when(k.isin(*URL_KEYS), sanitize_url(v))
        .otherwise(clean_text(v)),
    )


def clean_list(values: Column) -> Column:
    # in two steps: within one, every mention of the text would hide the queries again
    return F.transform(F.transform(values, hide_url_queries), lambda v: hide_secrets(v))


def json_payload(response: Column) -> Column:
    """Outermost object or array of a model reply, fences removed; NULL when absent."""
    text = F.regexp_replace(response, r"(?U)^\s+|\s+$", "")
    fenced = F.regexp_replace(F.regexp_replace(text, r"^```[^\n]*\n?", ""), r"\n?[ \t]*```[^\n]*$", "")
    body = F.when(F.startswith(text, F.lit("```")), fenced).otherwise(text)
    obj = F.regexp_extract(body, r"(?s)\{.*\}", 0)
    arr = F.regexp_extract(body, r"(?s)\[.*\]", 0)
    obj_at, arr_at = F.instr(body, "{"), F.instr(body, "[")
    return (
        F.when((obj != "") & ((arr == "") | (obj_at < arr_at)), obj).when(arr != "", arr)
    )
