"""Language identification with spans of mixed-language text.

A word's script, told from its UTF-8 lead bytes, leaves as candidates the
languages that are written in it.  Each candidate is scored by the word's byte
trigrams and the word itself, with log frequencies counted over all training
documents.  Viterbi over the words of a document, with a penalty for switching,
labels every word; runs of one label are the spans, and the label with most
letters is the document's language.

Defined results: null texts and texts without a letter are ``und`` with score 0;
letters of a script no language was learned with give the most frequent
language with score 0; with nothing to learn from, all is ``und``; ties go to
the first language in order; repeated rows give one row each; an empty table
gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesieve.llm.common import small_batches
from pagesieve.llm.tokens import Words, byte_slices, words

_BYTE = np.arange(256)
LETTERS = (_BYTE >= 0x80) | ((_BYTE >= 0x61) & (_BYTE <= 0x7A))
TRIGRAMS = WORDS = 1 << 15
#: Scripts by the lead bytes of their UTF-8 ranges (first, last).
SCRIPTS = (
    ("latin", 0x61, 0x7A), ("latin", 0xC3, 0xC9), ("greek", 0xCD, 0xCF), ("cyrillic", 0xD0, 0xD4), ("armenian-hebrew", 0xD5, 0xD7),
    ("arabic", 0xD8, 0xDD), ("indic-thai", 0xE0, 0xE0), ("georgian-ethiopic-khmer", 0xE1, 0xE1), ("han-kana", 0xE3, 0xE9), ("hangul", 0xEA, 0xED),
)
_NAMES = tuple(dict.fromkeys(s for s, _, _ in SCRIPTS))
_SCRIPT = np.zeros(256, np.uint8)  # 0: tells nothing
for _name, _first, _last in SCRIPTS:
    _SCRIPT[_first : _last + 1] = _NAMES.index(_name) + 1
N_SCRIPTS = len(_NAMES) + 1
FEATURES = TRIGRAMS + WORDS + N_SCRIPTS
MAX_LANGS = 1000
SWITCH_PENALTY, WORD_WEIGHT, MIN_SCRIPT_SHARE = 15.0, 1.0, 0.01
UNDETERMINED = "und"


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # (language, trigram or word bucket): log frequency
    written: np.ndarray  # (script, language): a candidate
    prior: int
    penalty: float


def _features(found: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigram bucket of each word byte, word bucket and script of each word."""
    data = found.data
    inside = LETTERS[data]
    left, right = np.empty(len(data), np.uint32), np.empty(len(data), np.uint32)
    left[1:], right[:-1] = data[:-1], data[1:]
    left[found.starts], right[found.ends - 1] = 0x20, 0x20
    code = (left << np.uint32(16)) | (data.astype(np.uint32) << np.uint32(8)) | right
    trigram = (code[inside] * np.uint32(2654435761)) >> np.uint32(17)
    word = (found.hashes >> np.uint64(40)).astype(np.int64) & (WORDS - 1)
    script = np.maximum.reduceat(_SCRIPT[data[inside]], _at(found)) if len(found.starts) else np.zeros(0, np.uint8)
    return trigram, word, script


def _at(found: Words) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(found.ends - found.starts)[:-1]))


def _count(langs: list[str]):
    index = {x: i for i, x in enumerate(langs)}

    def run(batches):
        total = np.zeros(FEATURES * len(langs), np.int64)
        for batch in batches:
            lang = np.array([index[x] for x in batch.column(0).to_pylist()], np.int64)
            for found in words(batch.column(1), LETTERS):
                if not len(found.starts):
                    continue
                trigram, word, script = _features(found)
                own = np.repeat(lang[found.first : found.first + len(found.counts)], found.counts)
                by_byte = np.repeat(own, found.ends - found.starts)
                for feature, label in ((trigram, by_byte), (TRIGRAMS + word, own), (TRIGRAMS + WORDS + script.astype(np.int64), own)):
                    total += np.bincount(feature.astype(np.int64) * len(langs) + label, minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.record_batch({"at": at, "n": total[at]})

    return run


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", penalty: float = SWITCH_PENALTY) -> Model:
    """Count features over all rows with a language.

    The driver receives one row a feature and language at most: 65,547 features,
    ``MAX_LANGS`` languages, however many documents.
    """
    known = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    names = sorted(r[0] for r in known.select("lang").distinct().limit(MAX_LANGS + 1).collect())
    if len(names) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    if not names:
        return Model([], np.zeros((0, TRIGRAMS + WORDS), np.float32), np.zeros((N_SCRIPTS, 0), bool), 0, penalty)
    rows = known.mapInArrow(_count(names), "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(FEATURES * len(names))
    counts[rows["at"].to_numpy()] = rows["n"].to_numpy()
    counts = counts.reshape(FEATURES, len(names))
    logs = [np.log((part + 0.5) / (part.sum(0) + 0.5 * len(part))) for part in (counts[:TRIGRAMS], counts[TRIGRAMS : TRIGRAMS + WORDS])]
    logs[1] *= WORD_WEIGHT
    scripts = counts[TRIGRAMS + WORDS :]
    written = scripts > MIN_SCRIPT_SHARE * np.maximum(scripts[1:].sum(0), 1)
    written[0] = True  # marks without a script exclude nothing
    return Model(names, np.ascontiguousarray(np.concatenate(logs).T, np.float32), written, int(scripts.sum(0).argmax()), penalty)


def word_scores(found: Words, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Score of each word in each language, and whether the word tells anything."""
    trigram, word, script = _features(found)
    at = _at(found)
    scores = np.empty((len(found.starts), len(model.langs)), np.float32)
    for i, weights in enumerate(model.weights):
        scores[:, i] = np.add.reduceat(weights[trigram], at) + weights[TRIGRAMS + word]
    candidates = model.written[script]
    telling = candidates.any(1) & (script > 0)
    scores[~telling] = 0
    return np.where(candidates | ~telling[:, None], scores, np.float32(-1e6)), telling


def viterbi(scores: np.ndarray, offsets: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of every word; the documents between ``offsets`` advance together, the longest first."""
    counts = np.diff(offsets)
    order = np.argsort(-counts, kind="stable")
    starts, ordered = offsets[:-1][order], counts[order]
    stays, best = np.zeros(scores.shape, bool), np.zeros(len(scores), np.int32)
    value = np.zeros((len(counts), scores.shape[1]))
    longest = int(counts.max(initial=0))
    active = np.searchsorted(-ordered, -np.arange(longest), "left")  # documents with more than t words
    for t in range(longest):
        a = active[t]
        at = starts[:a] + t
        own = value[:a]
        if t:
            most = own.argmax(1)
            jump = own[np.arange(a), most] - penalty
            best[at], stays[at] = most, own >= jump[:, None]
            np.maximum(own, jump[:, None], out=own)
        own += scores[at]
    label = np.zeros(len(scores), np.int32)
    state = value.argmax(1).astype(np.int32)
    for t in range(longest - 1, -1, -1):
        a = active[t]
        at = starts[:a] + t
        label[at] = state[:a]
        state[:a] = np.where(stays[at, state[:a]], state[:a], best[at])
    return label


def _runs(row: np.ndarray, label: np.ndarray) -> np.ndarray:
    """First word of each run of one label in a row."""
    return np.flatnonzero(np.concatenate(([True], (label[1:] != label[:-1]) | (row[1:] != row[:-1])))) if len(label) else np.zeros(0, np.int64)


def _certainty(scores: np.ndarray, row: np.ndarray, label: np.ndarray, size: np.ndarray, n: int) -> np.ndarray:
    """By row the mean posterior of the labels of its spans, each within its span, weighted by letters."""
    first = _runs(row, label)
    total = np.add.reduceat(scores, first, axis=0, dtype=np.float64)
    odds = np.exp(total - total.max(1, keepdims=True))
    sure = odds[np.arange(len(first)), label[first]] / odds.sum(1)
    weight = np.add.reduceat(size, first)
    return np.bincount(row[first], sure * weight, n) / np.maximum(np.bincount(row[first], weight, n), 1)


def _spans(found: Words, label: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of one label: row, label, start and end in code points of the text."""
    n = len(label)
    row = np.repeat(np.arange(len(found.counts)), found.counts)
    first = _runs(row, label)
    last = np.concatenate((first[1:], [n])) - 1 if n else first
    points = np.concatenate(([0], np.cumsum((found.data & 0xC0) != 0x80)))
    base = points[found.row_starts[:-1]][row[first]]
    return row[first], label[first], points[found.starts[first]] - base, points[found.ends[last]] - base


def _predict(sent):
    """``sent``: the model as a broadcast variable."""
    model = sent.value
    names = pa.array([*model.langs, UNDETERMINED])
    kind = pa.struct([("lang", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    n_langs = len(model.langs)

    def run(batches):
        for batch in byte_slices(batches, 1):
            n = batch.num_rows
            pred, score, certainty = np.full(n, n_langs), np.zeros(n), np.zeros(n)
            parts = [[np.zeros(0, np.int64)] for _ in range(4)]
            for found in words(batch.column(1), LETTERS) if n_langs else ():
                rows = slice(found.first, found.first + len(found.counts))
                row = np.repeat(np.arange(len(found.counts)), found.counts)
                if not len(row):
                    continue
                scores, telling = word_scores(found, model)
                label = viterbi(scores, found.offsets, model.penalty)
                size = np.where(telling, found.ends - found.starts, 0)
                letters = np.bincount(row * n_langs + label, size, len(found.counts) * n_langs).reshape(-1, n_langs)
                total = np.stack([np.bincount(row, scores[:, i].astype(float), len(found.counts)) for i in range(n_langs)], 1)
                known = letters.sum(1) > 0
                own = np.where(known, letters.argmax(1), model.prior)
                share = letters[np.arange(len(own)), own] / np.maximum(letters.sum(1), 1)
                odds = np.exp(total - total.max(1, keepdims=True))
                sure = odds[np.arange(len(own)), own] / odds.sum(1)
                # a text of two languages in equal parts is sure of its spans, not of one language: the share says so
                pred[rows], score[rows] = own, np.where(known, share * np.maximum(sure, 1 / n_langs), 0)
                certainty[rows] = _certainty(scores, row, label, size, len(own))
                for out, part in zip(parts, _spans(found, label), strict=True):
                    out.append(part)
                parts[0][-1] = parts[0][-1] + found.first
                ascii_letter = np.bincount(row, np.maximum.reduceat((found.data[LETTERS[found.data]] < 0x80).astype(np.int64), _at(found)), len(found.counts)) > 0
                has_words = found.counts > 0
                for r in np.flatnonzero(has_words & ~ascii_letter):  # few: look whether a mark is a letter
                    if not any(map(str.isalpha, batch.column(1)[found.first + int(r)].as_py())):
                        pred[found.first + r], score[found.first + r] = n_langs, 0
                        certainty[found.first + r] = 0
                empty = ~has_words
                pred[rows] = np.where(empty, n_langs, pred[rows])
                score[rows] = np.where(empty, 0, score[rows])
            row, label, start, end = (np.concatenate(p) for p in parts)
            keep = pred[row] < n_langs
            row, label, start, end = row[keep], label[keep], start[keep], end[keep]
            structs = pa.StructArray.from_arrays([names.take(pa.array(label)), pa.array(start.astype(np.int64)), pa.array(end.astype(np.int64))], fields=list(kind))
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32)), structs)
            yield pa.record_batch([batch.column(0), names.take(pa.array(pred)), pa.array(np.clip(score, 0, 1)), lists, pa.array(np.clip(certainty, 0, 1))], ["id", "lang_pred", "score", "spans", "certainty"])

    return run


def told(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    """Struct of the language (``lang``) and ``certainty`` of the rows of ``docs``; only texts travel to Python, and only once."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang: string, certainty: double>")
    def tell(text: pa.Array) -> pa.Array:
        parts = list(_predict(sent)([pa.record_batch([text, text], ["id", "text"])]))
        columns = [pa.concat_arrays([p.column(c) for p in parts]) if parts else pa.array([], kind) for c, kind in (("lang_pred", pa.string()), ("certainty", pa.float64()))]
        return pa.StructArray.from_arrays(columns, ["lang", "certainty"])

    return tell.asNondeterministic()(F.col(text_col).cast("string"))  # else a filter would tell a second time


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``lang_pred``, ``score``, ``spans`` and ``certainty``.

    ``score`` is of the one language ``lang_pred``; ``certainty`` says how surely the
    spans are labelled, in however many languages.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = slim.select("id", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), F.array(F.struct(F.lit("").alias("lang"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end"))).alias("spans"), F.lit(0.0).alias("certainty")).schema
    return slim.mapInArrow(lambda batches: _predict(sent)(batches), schema).withColumnRenamed("id", id_col)


def held_out(id_col: str = "doc_id") -> Column:
    """A third of the ids, by checksum; null ids are not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))
