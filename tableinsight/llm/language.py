"""Which languages a document mixes, by expectation-maximisation over letter trigram models.

Method. Every language has a model of letter sequences: the chance of a symbol after the two before
it, learned from the labelled documents and interpolated with shorter contexts. A document is a
mixture: each word comes from one language. Expectation-maximisation estimates the proportions;
languages are then taken up in the order of their proportions for as long as the likelihood, less a
penalty of half the logarithm of the number of words per language, grows. The prediction is the
language with the largest proportion of the set chosen, the score that proportion.

Counting covers every labelled document. Symbols are 64 classes of bytes, so a language has at most
64^3 counts whatever the input; they are summed by Spark and only these sums come to the driver.

Defined results. A text that is null or has no letter is ``und`` with score 0; so is every text when
nothing was learned. Repeated documents keep their rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableinsight.llm import bytetext
from tableinsight.llm.common import in_arrow

SYMBOLS = 64
UNKNOWN = "und"
ROUNDS = 12
_LETTER = regex.compile(r"\p{L}")

# Letters have classes of their own, bytes of other code points share 37, all else separates words.
_CODES = np.zeros(256, dtype=np.int32)
for _byte in range(256):
    if chr(_byte).isascii() and chr(_byte).isalpha():
        _CODES[_byte] = ord(chr(_byte).lower()) - 96
    elif _byte >= 128:
        _CODES[_byte] = 27 + _byte % 37


@dataclass
class Letters:
    trigrams: np.ndarray  # per byte: itself and the two before it in its word
    starts: np.ndarray
    ends: np.ndarray  # one past the separator that closes each word
    bounds: np.ndarray


def letters(texts: bytetext.Texts) -> Letters:
    """Words are runs of letters; each is read from a separator to the separator after it."""
    # One separator after every text, so that each word of each text has both.
    codes = np.zeros(len(texts.data) + len(texts) + 1, dtype=np.int32)
    shift = np.repeat(np.arange(1, len(texts) + 1), np.diff(texts.offsets))
    codes[np.arange(len(texts.data)) + shift] = _CODES[texts.data]
    offsets = texts.offsets + np.arange(len(texts) + 1)
    before = np.concatenate(([0], codes[:-1]))
    earlier = np.concatenate(([0], before[:-1]))
    trigrams = np.where(before == 0, codes, (earlier * SYMBOLS + before) * SYMBOLS + codes)
    inside = codes > 0
    step = np.diff(inside.astype(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1) + 1
    return Letters(trigrams, starts, ends, np.searchsorted(starts, offsets + 1))


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigram counts of the labelled texts of a task, per language: (lang, trigram, n)."""
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        for texts in bytetext.slices(batch.column("text")):
            found = letters(texts)
            word = np.zeros(len(found.trigrams) + 1, dtype=np.int8)
            word[found.starts] += 1
            word[found.ends] -= 1
            used = np.cumsum(word[:-1]).astype(bool)
            offsets = texts.offsets + np.arange(len(texts) + 1) + 1
            own = np.array(langs[texts.first : texts.first + len(texts)], dtype=object)
            for lang in set(own):
                mask = used.copy()
                for i in np.flatnonzero(own != lang):
                    mask[offsets[i] : offsets[i + 1]] = False
                fresh = np.bincount(found.trigrams[mask], minlength=SYMBOLS**3)
                counts[lang] = counts.get(lang, 0) + fresh
    for lang, n in counts.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])],
            names=["lang", "trigram", "n"],
        )


def smoothed(counts: np.ndarray) -> np.ndarray:
    """Log chances of the last symbol of each trigram; each order backs off by Witten-Bell weights."""
    three = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(np.float64)
    two, one = three.sum(axis=0), three.sum(axis=(0, 1))

    def interpolate(n: np.ndarray, shorter: np.ndarray) -> np.ndarray:
        kinds = (n > 0).sum(axis=-1, keepdims=True)
        total = n.sum(axis=-1, keepdims=True)
        return np.where(total > 0, (n + kinds * shorter) / np.maximum(total + kinds, 1), shorter)

    chance = np.full(SYMBOLS, 1 / SYMBOLS)
    for n in (one, two, three):
        chance = interpolate(n, chance)
    return np.log(chance).astype(np.float32).reshape(-1)


@dataclass
class Model:
    langs: list[str]
    logs: list[np.ndarray]  # one table of 64^3 per language


def learn(labelled: DataFrame) -> Model:
    """From (text, lang) rows with a language."""
    sums = in_arrow(labelled.select("text", "lang"), _counter, "lang string, trigram int, n long")
    table = sums.groupBy("lang", "trigram").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(table.column("lang").to_pylist()), key=lambda x: x.encode())
    place = {lang: i for i, lang in enumerate(langs)}
    counts = np.zeros((len(langs), SYMBOLS**3), dtype=np.int64)
    rows = np.array([place[x] for x in table.column("lang").to_pylist()], dtype=np.int64)
    counts[rows, table.column("trigram").to_numpy()] = table.column("n").to_numpy()
    return Model(langs, [smoothed(c) for c in counts])


def _maximise(
    chances: np.ndarray, doc: np.ndarray, bounds: np.ndarray, allowed: np.ndarray, rounds: int
) -> tuple[np.ndarray, np.ndarray]:
    """(shares, log-likelihoods) of many documents at once; every document has words."""
    shares = allowed / allowed.sum(axis=1, keepdims=True)
    n = np.diff(bounds)[:, None]
    for _ in range(rounds):
        joint = chances * shares[doc]
        joint /= joint.sum(axis=1, keepdims=True)
        shares = np.add.reduceat(joint, bounds[:-1], axis=0) / n
    total = np.log((chances * shares[doc]).sum(axis=1))
    return shares, np.add.reduceat(total, bounds[:-1])


def mixtures(model: Model, texts: bytetext.Texts, rounds: int = ROUNDS) -> np.ndarray:
    """Shares of the languages in each text; zeros where a text has no words."""
    found = letters(texts)
    out = np.zeros((len(texts), len(model.langs)))
    filled = np.flatnonzero(np.diff(found.bounds))
    if not len(filled) or not model.langs:
        return out
    logs = np.empty((len(found.starts), len(model.langs)), dtype=np.float64)
    edges = np.stack((found.starts, found.ends), axis=1).reshape(-1)
    padded = np.append(found.trigrams, 0)
    for j, table in enumerate(model.logs):
        logs[:, j] = np.add.reduceat(table[padded], edges)[::2]
    bounds = np.append(found.bounds[filled], found.bounds[-1])
    n = np.diff(bounds)
    doc = np.repeat(np.arange(len(filled)), n)
    chances = np.exp(logs - logs.max(axis=1, keepdims=True)) + 1e-12
    everything = np.ones((len(filled), len(model.langs)))
    shares, _ = _maximise(chances, doc, bounds, everything, rounds)
    order = np.argsort(-shares, axis=1, kind="stable")
    best = np.zeros_like(shares)
    best[np.arange(len(filled)), order[:, 0]] = 1
    score = np.add.reduceat(np.log(chances[np.arange(len(doc)), order[doc, 0]]), bounds[:-1])
    penalty = 0.5 * np.log(n + 1.0)
    growing = np.arange(len(filled))
    for k in range(2, len(model.langs) + 1):
        # A document goes on only while the language taken up last has paid for itself.
        rank = shares[growing, order[growing, k - 1]] * n[growing]
        growing = growing[rank > 0.5]
        if not len(growing):
            break
        words = np.concatenate([np.arange(bounds[i], bounds[i + 1]) for i in growing])
        sub_bounds = np.concatenate(([0], np.cumsum(n[growing])))
        allowed = np.zeros((len(growing), len(model.langs)))
        np.put_along_axis(allowed, order[growing, :k], 1.0, axis=1)
        sub_doc = np.repeat(np.arange(len(growing)), n[growing])
        mixed, likely = _maximise(chances[words], sub_doc, sub_bounds, allowed, rounds)
        better = likely - penalty[growing] > score[growing]
        growing, mixed, likely = growing[better], mixed[better], likely[better]
        best[growing] = mixed
        score[growing] = likely - penalty[growing]
    out[filled] = best
    return out


def _predictor(model: object) -> object:
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Model = model.value
        for batch in batches:
            column = batch.column("text")
            langs, scores, mixes = [], [], []
            for texts in bytetext.slices(column):
                shares = mixtures(known, texts)
                for i, own in enumerate(shares):
                    top = int(own.argmax()) if len(own) else 0
                    text = column[texts.first + i].as_py()
                    sure = len(own) and own[top] > 0 and text is not None and _LETTER.search(text)
                    langs.append(known.langs[top] if sure else UNKNOWN)
                    scores.append(float(own[top]) if sure else 0.0)
                    mixes.append(
                        [{"lang": known.langs[j], "share": float(own[j])} for j in np.flatnonzero(own)]
                        if sure else []
                    )
            kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64()),
                 pa.array(mixes, kind)],
                names=["doc_id", "lang_pred", "score", "mixture"],
            )

    return predict


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Per document: doc_id, lang_pred, score, mixture (the languages chosen and their shares)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return in_arrow(
        rows, _predictor(shared),
        "doc_id long, lang_pred string, score double, mixture array<struct<lang:string,share:double>>",
    )
