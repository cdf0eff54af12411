"""Language identification in two steps: first the family, then the language within it.

Texts are described by hashed letter trigrams (lower case, a space at word edges) as
shares of all trigrams. One-versus-one linear support vector machines tell families
apart; within a family, further ones tell its languages apart. A text's margins in all
of them are sums of one table's rows, so scoring reads each character once.

Training reads at most ``TRAINING`` documents with a language (those with the least
hash of doc_id), in one task whose input that number bounds. Texts are scored whole.

Defined cases: a null text and one without letters are ``und`` with score 0; without
training documents every text is; languages outside the known families make families of
their own; a doc_id with several languages counts by the one that sorts last; repeated
rows give a row each; a null doc_id is kept and never held out; an empty table gives an
empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordmill.llm import blocks
from wordmill.llm.shared import modest

#: Documents that are read for training at most, hash bits of trigrams, passes and the weight of the squared norm.
TRAINING, BITS, PASSES, NORM = 2_500, 13, 120, 1e-4
FOLDS, HELD = 4, 2

# Families of closely related languages.
FAMILIES = {
    "germanic": ("da", "de", "en", "nl", "no", "sv"),
    "romance": ("ca", "es", "fr", "it", "pt", "ro"),
    "slavic": ("bg", "cs", "pl", "ru", "sk", "uk"),
}


def held_out(doc_id: Column, folds: int = FOLDS, fold: int = HELD) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def family(language: str) -> str:
    return next((k for k, v in FAMILIES.items() if language in v), language)


_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def trigrams(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed trigrams around every letter of all texts, the text of each, and whether each text has a letter."""
    text = [(t.decode("utf-8", "replace").lower() if t else "") + "  " for t in texts]
    points = np.frombuffer(" ".join([*text, ""]).encode("utf-32-le"), np.uint32).copy()
    letter = letters()[points]
    points[~letter] = 32
    before, after = np.roll(points, 1), np.roll(points, -1)
    at = np.flatnonzero(letter)
    h = (before[at] * np.uint32(0x9E3779B1)) ^ (points[at] * np.uint32(0x85EBCA6B) + np.uint32(0x27D4EB2F)) ^ (after[at] * np.uint32(0xC2B2AE35))
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in text), np.int64, len(text)))
    owner = np.searchsorted(ends, at, side="right")
    return (h >> np.uint32(32 - BITS)).astype(np.int64), owner, np.bincount(owner, minlength=len(texts)) > 0


def machine(x: np.ndarray, y: np.ndarray, passes: int = PASSES) -> tuple[np.ndarray, float]:
    """Weights and constant of a linear support vector machine (squared hinge, classes weighed alike), by accelerated descent."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = u = np.zeros(x.shape[1] + 1, np.float32)
    top = float((weight * (1 + (x * x).sum(axis=1))).sum()) * 2  # bounds the curvature
    for t in range(passes):
        slack = np.maximum(0, 1 - y * (x @ u[:-1] + u[-1]))
        pull = -2 * weight * slack * y
        g = np.append(x.T @ pull, pull.sum()).astype(np.float32)
        g[:-1] += 2 * NORM * u[:-1]
        nxt = u - g / np.float32(top + 2 * NORM)
        u = nxt + np.float32(t / (t + 3)) * (nxt - w)
        w = nxt
    return w[:-1], float(w[-1])


def train(x: np.ndarray, languages: list[str]) -> dict:
    """Machines for every two families and every two languages of one family."""
    names = sorted(set(languages))
    kin = {n: family(n) for n in names}
    of = np.array(languages)
    kin_of = np.array([kin[n] for n in languages])
    model = {"names": names, "families": sorted(set(kin.values())), "contests": [], "w": [], "b": []}

    def contest(level: str, a: str, b: str, group: np.ndarray) -> None:
        rows = np.flatnonzero((group == a) | (group == b))
        w, c = machine(x[rows], np.where(group[rows] == a, 1, -1).astype(np.float32))
        model["contests"].append((level, a, b))
        model["w"].append(w)
        model["b"].append(c)

    for a, b in combinations(model["families"], 2):
        contest("family", a, b, kin_of)
    for f in model["families"]:
        for a, b in combinations([n for n in names if kin[n] == f], 2):
            contest("language", a, b, of)
    model["w"] = np.stack(model["w"], axis=1).astype(np.float32) if model["w"] else np.zeros((1 << BITS, 0), np.float32)
    model["b"] = np.array(model["b"], np.float32)
    return model


def decide(model: dict, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The language of each row of margins, and a score from its closest contest."""
    n = len(margins)

    def winner(level: str, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(names) == 1:
            return np.zeros(n, np.int64), np.full(n, np.inf)
        total, least = np.zeros((n, len(names))), np.full((n, len(names)), np.inf)
        for k, (kind, a, b) in enumerate(model["contests"]):
            if kind == level and a in names and b in names:
                for name, m in ((a, margins[:, k]), (b, -margins[:, k])):
                    i = names.index(name)
                    total[:, i] += np.clip(m, -1, 1)
                    least[:, i] = np.minimum(least[:, i], m)
        best = total.argmax(axis=1)
        return best, least[np.arange(n), best]

    best, sure = winner("family", model["families"])
    out, score = np.zeros(n, object), np.zeros(n)
    for i, f in enumerate(model["families"]):
        own = [x for x in model["names"] if family(x) == f]
        at = np.flatnonzero(best == i)
        inner, inner_sure = (z[at] for z in winner("language", own))
        out[at] = np.array(own, object)[inner]
        score[at] = 1 / (1 + np.exp(-2 * np.clip(np.minimum(sure[at], inner_sure), -20, 20)))
    return out, score


def fitted(docs: DataFrame, most: int = TRAINING) -> dict | None:
    """The model learned from ``docs`` (doc_id, text, lang); None if no text has a language and a letter."""
    modest(docs.sparkSession)
    known = docs.where("doc_id is not null and lang is not null and text is not null").select("doc_id", "lang", "text")
    keys = known.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)  # at most so many rows are broadcast
    rows = known.join(F.broadcast(keys), "doc_id").groupBy("doc_id").agg(F.max("lang").alias("lang"), F.max("text").alias("text"))

    @blocks.frugal
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pickle

        shares, languages = [], []
        for batch in batches:
            texts, langs = blocks.encoded(batch.column("text")), batch.column("lang").to_pylist()
            for first, end in blocks.pieces(texts):
                features, owner, has = trigrams(texts[first:end])
                counts = np.bincount(owner * (1 << BITS) + features, minlength=(end - first) << BITS).reshape(end - first, -1).astype(np.float32)
                for i in np.flatnonzero(has).tolist():
                    shares.append(scaled(counts[i], counts[i].sum()))
                    languages.append(langs[first + i])
        if languages:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(np.stack(shares), languages))], pa.binary())], ["model"])

    import pickle

    found = rows.coalesce(1).mapInArrow(task, "model binary").collect()
    return pickle.loads(bytes(found[0]["model"])) if found else None


def scaled(counts: np.ndarray, total) -> np.ndarray:
    return counts * np.float32(20) / np.float32(total)


def predicted(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, lang_pred, score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @blocks.frugal
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = blocks.encoded(batch.column("text"))
            langs, score = np.full(len(texts), "und", object), np.zeros(len(texts))
            for first, end in blocks.pieces(texts) if m else ():
                features, owner, has = trigrams(texts[first:end])
                count = np.bincount(owner, minlength=end - first)
                sums = np.stack([np.bincount(owner, m["w"][:, k][features], end - first) for k in range(m["w"].shape[1])], axis=1) if m["w"].shape[1] else np.zeros((end - first, 0))
                at = np.flatnonzero(has)
                margins = sums[at] * 20 / count[at, None] + m["b"]
                langs[first + at], score[first + at] = decide(m, margins)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs.tolist(), pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(task, "doc_id long, lang_pred string, score double")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learned from three of four folds."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = fitted(docs.where(~held_out(F.col("doc_id"))))
    return predicted(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
