"""URL filters: all glob rules run at once as a bit-parallel automaton.

Rules are globs over canonical URLs (lower-cased host, then path): ``*`` stands
for characters other than ``/``, ``**`` for any.  Every rule character is a bit;
the bits of all rules are packed into 64-bit words.  Reading one byte moves all
states of all rules by one shift, one mask of the states that accept the byte
and one mask of the stars that stay (Shift-And).  A block of URLs is read column by column,
so the work is vectorised over URLs and rule words.

Defined results: a null url, or one without ``://``, has an empty host and path
and fits no rule; repeated rows give one row each; ties between equally long
rules go to the one listed first; an empty table gives no rows; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    name: str
    globs: tuple[str, ...]
    #: Rules of a higher tier win over longer ones of a lower tier.
    tier: int = 1


def domain_rule(verdict: str, host: str, path: str) -> Rule:
    """A host with all its subdomains, and every path that starts with ``path``."""
    return Rule(verdict, host + path, (f"{host}{path}**", f"*.{host}{path}**"))


class Automaton:
    """Shift-And masks of many globs; ``run`` simulates all of them over each string."""

    def __init__(self, globs: list[str]):
        self.owner: list[int] = []  # glob of each final bit
        steps: list[tuple[int, str]] = []  # per bit: -1 start, 0..255 byte; star kind that may loop there
        final: list[int] = []
        for glob in globs:
            steps.append((-1, ""))
            rest = glob.encode()
            while rest:
                if rest.startswith(b"*"):
                    kind = "**" if rest.startswith(b"**") else "*"
                    steps[-1] = (steps[-1][0], max(kind, steps[-1][1], key=len))
                    rest = rest[len(kind) :]
                else:
                    steps.append((rest[0], ""))
                    rest = rest[1:]
            final.append(len(steps) - 1)
        self.n_words = max(1, -(-len(steps) // 64))
        self.accept = np.zeros((256, self.n_words), np.uint64)
        self.stay = np.zeros((256, self.n_words), np.uint64)
        self.start = np.zeros(self.n_words, np.uint64)
        for i, (byte, star) in enumerate(steps):
            word, bit = i // 64, np.uint64(1) << np.uint64(i % 64)
            if byte < 0:
                self.start[word] |= bit
            else:
                self.accept[byte, word] |= bit
            if star:
                self.stay[:, word] |= bit
                if star == "*":
                    self.stay[0x2F, word] &= ~bit
        self.final = final

    def run(self, column: pa.Array) -> np.ndarray:
        """For each string, the state words after its last byte."""
        column = pc.fill_null(column, "")
        lengths = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
        order = np.argsort(-lengths, kind="stable")
        ordered = column.take(pa.array(order))
        starts = np.frombuffer(ordered.buffers()[1], np.int32)[ordered.offset :][: len(order)].astype(np.int64)
        data = np.frombuffer(ordered.buffers()[2], np.uint8) if lengths.sum() else np.zeros(0, np.uint8)
        state = np.tile(self.start, (len(order), 1))
        active, sorted_lengths = len(order), lengths[order]
        for place in range(int(lengths.max(initial=0))):
            while sorted_lengths[active - 1] <= place:  # the shortest strings are done
                active -= 1
            byte = data[starts[:active] + place]
            own = state[:active]
            moved = own << np.uint64(1)
            moved[:, 1:] |= own[:, :-1] >> np.uint64(63)
            state[:active] = (moved & self.accept[byte]) | (own & self.stay[byte])
        out = np.empty_like(state)
        out[order] = state
        return out

    def matches(self, state: np.ndarray, glob: int) -> np.ndarray:
        bit = self.final[glob]
        return (state[:, bit // 64] >> np.uint64(bit % 64)) & np.uint64(1) == 1


def _judge(rules: tuple[Rule, ...], default: str):
    globs = [(g, i) for i, rule in enumerate(rules) for g in rule.globs]
    automaton = Automaton([g for g, _ in globs])
    # weakest first, so that the strongest rule is written last
    strength = lambda i: (rules[i].tier, len(rules[i].name), -i)
    order = sorted(range(len(globs)), key=lambda j: strength(globs[j][1]))
    names = pa.array([r.name for r in rules] + [None], pa.string())
    verdicts = pa.array([r.verdict for r in rules] + [default], pa.string())
    tiers = pa.array([r.tier for r in rules] + [None], pa.int32())

    def run(batches):
        for batch in batches:
            url = pc.binary_join_element_wise(batch.column("host"), batch.column("path"), "")
            state = automaton.run(url)
            best = np.full(batch.num_rows, len(rules))
            for j in order:
                best[automaton.matches(state, j)] = globs[j][1]
            best = pa.array(best)
            yield pa.record_batch([batch.column("id"), batch.column("host"), batch.column("path"), names.take(best), verdicts.take(best), tiers.take(best)], ["id", "host", "path", "rule", "verdict", "tier"])

    return run


def judge(pages: DataFrame, rules: tuple[Rule, ...], default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per row: id, host, path, the winning rule's name, verdict and tier (null, ``default``, null without one)."""
    url = F.col(url_col).cast("string")
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda i: F.coalesce(F.regexp_extract(url, parts, i), F.lit(""))
    slim = pages.select(F.col(id_col).alias("id"), F.translate(part(1), UPPER, LOWER).alias("host"), part(2).alias("path"))
    schema = f"id {dict(slim.dtypes)['id']}, host string, path string, rule string, verdict string, tier int"
    return slim.mapInArrow(_judge(tuple(rules), default), schema).withColumnRenamed("id", id_col)


#: Domain rules of the query, then house rules that only speak where no domain rule fits.
DOMAIN_RULES = (
    domain_rule("allow", "org", "/"),
    domain_rule("block", "example.org", "/es/"),
    domain_rule("block", "example.org", "/en/1"),
    domain_rule("allow", "com", "/fr/"),
    domain_rule("block", "com", "/de/"),
)
HOUSE_RULES = tuple(
    Rule("block", glob, (glob,), tier=0)
    for glob in ("*ads-track.**", "*spam-farm.**", "*free-bets.**", "*doubleclick.**", "**/login**", "**/wp-admin/**", "**.exe", "**.zip")
)

ORACLE = r"""
WITH parts AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
rules AS (
  SELECT * FROM (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')) AS r(verdict, h, p)),
best AS (
  SELECT page_id, arg_max(h || p, len(h || p)) AS rule, arg_max(verdict, len(h || p)) AS verdict
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT page_id, host, path, rule,
       coalesce(verdict, CASE WHEN regexp_matches(host, '(ads-track|spam-farm|free-bets|doubleclick)\.') OR regexp_matches(path, '/login[^/]*$|/wp-admin/|\.exe$|\.zip$') THEN 'block' ELSE 'allow' END) AS verdict
FROM parts LEFT JOIN best USING (page_id)
"""
