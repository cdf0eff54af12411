"""Toxicity by multiple-instance learning: documents are labelled, sentences are scored.

A sentence's score is a logistic function of its hashed words and beginnings of words
(so that inflected and compound forms of a word count alike). A document's score joins
its sentences' scores by noisy-or, 1 - prod(1 - p), and the weights are trained so that
these joint scores meet the documents' labels; the same weights then tell the offending
sentences.

Training reads at most ``TRAINING`` labelled documents (those with the least hash of
doc_id), in one task whose input that number bounds. Texts are scored whole.

Defined cases: a null or empty text, or one without words, has score 0; without labelled
documents every score is close to 0; a doc_id with several labels counts as toxic if one
is; repeated rows give a row each; a null doc_id is kept and never held out; an empty
table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordmill.llm import blocks
from wordmill.llm.shared import modest

#: Labelled documents that are read for training at most, hash bits of words, and passes.
TRAINING, BITS, PASSES = 10_000, 20, 150
#: Bytes of a word's beginnings that count beside the whole word.
BEGINNINGS = (4, 5, 6, 7)
#: Features of fewer toxic documents, or fewer than so many standard deviations above chance, keep weight 0.
LEAST, FAR = 4, 6.5
#: The logit of a sentence without other features to begin with, and what each pass takes from each weight.
START, SHRINK = -6.0, 0.005
FOLDS, HELD = 5, 0

# letters, digits, the apostrophe and all bytes of other characters make words; these signs end sentences
_WORD = np.zeros(256, bool)
_WORD[[*b"abcdefghijklmnopqrstuvwxyz0123456789'", *range(128, 256)]] = True
_STOP = np.zeros(256, bool)
_STOP[[*b".!?\n"]] = True


def held_out(doc_id: Column, folds: int = FOLDS, fold: int = HELD) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def sentences(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed words and their beginnings in all texts, the sentence of each (counted over all texts), and the text of each sentence."""
    joined = (b"\n".join(t or b"" for t in texts) + b"\n").translate(blocks.LOWER)
    data = np.frombuffer(joined, np.uint8)
    word = _WORD[data]
    edge = np.diff(np.concatenate([[False], word]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    raw = np.cumsum(_STOP[data])[starts]
    first = np.concatenate([[True], raw[1:] != raw[:-1]]) if len(raw) else np.zeros(0, bool)
    lengths = np.fromiter((len(t) if t else 0 for t in texts), np.int64, len(texts))
    owner = np.searchsorted(np.cumsum(lengths + 1), starts[first], side="right")
    sentence = np.cumsum(first) - 1
    at, sentences_of = [ends], [sentence]
    begin = [starts]
    for n in BEGINNINGS:
        long = ends - starts > n
        begin.append(starts[long])
        at.append(starts[long] + n)
        sentences_of.append(sentence[long])
    hashes = blocks.slice_hashes(data, np.concatenate(begin), np.concatenate(at))
    kind = np.repeat(np.arange(len(at), dtype=np.uint64), [len(x) for x in at])
    features = (blocks.mix(hashes + kind) & np.uint64((1 << BITS) - 1)).astype(np.int64)
    return features, np.concatenate(sentences_of), owner


def in_documents(features: np.ndarray, sentence: np.ndarray, owner: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """In how many documents, and toxic ones, each feature is."""
    size = 1 << BITS
    pairs = np.unique((owner[sentence] if len(sentence) else sentence) * np.int64(size) + features)
    return np.bincount(pairs % size, minlength=size), np.bincount(pairs % size, labels[pairs // size], size)


def train(features: np.ndarray, sentence: np.ndarray, owner: np.ndarray, labels: np.ndarray, seen: np.ndarray, toxic: np.ndarray, passes: int = PASSES) -> np.ndarray:
    """Weights of features, and last the constant: Adam on the log-loss of noisy-or."""
    size = 1 << BITS
    rate = labels.mean() if len(labels) else 0.0
    # only features that toxic documents have far more often than chance gives are learned: rare ones would be learned by heart
    far = (toxic - seen * rate) >= FAR * np.sqrt(seen * rate * (1 - rate))
    keep = (far & (toxic >= LEAST))[features]
    once = np.unique(sentence[keep] * np.int64(size) + features[keep])
    features, sentence = once % size, once // size
    used, feature = np.unique(features, return_inverse=True)
    w, m, v = (np.zeros(len(used) + 1) for _ in range(3))
    w[-1] = START
    n = max(1, len(labels))
    for t in range(1, passes + 1):
        z = np.bincount(sentence, w[feature], len(owner)) + w[-1]
        p = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
        total = np.bincount(owner, np.logaddexp(0, z), len(labels))
        missed = -np.exp(-total) / np.maximum(-np.expm1(-total), 1e-9)
        slope = np.where(labels > 0, missed, 1.0)[owner] * p / n
        g = np.append(np.bincount(feature, slope[sentence], len(used)), slope.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.3 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-6)
        w[:-1] = np.sign(w[:-1]) * np.maximum(np.abs(w[:-1]) - SHRINK, 0)  # few features, each strong
    out = np.zeros(size + 1, np.float32)
    out[used], out[-1] = w[:-1], w[-1]
    return out


def fitted(docs: DataFrame, labels: DataFrame, most: int = TRAINING) -> np.ndarray:
    """Weights learned from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic)."""
    modest(docs.sparkSession)
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)  # at most so many rows are broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.max("toxic").alias("toxic"))

    @blocks.frugal
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, labels, sentences_so_far, texts_so_far = [], [], 0, 0
        seen, toxic = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS)
        for batch in batches:
            texts, marks = blocks.encoded(batch.column("text")), batch.column("toxic").to_numpy()
            labels.append(marks)
            for first, end in blocks.pieces(texts):
                features, sentence, owner = sentences(texts[first:end])
                for total, x in zip((seen, toxic), in_documents(features, sentence, owner, marks[first:end])):
                    total += x.astype(total.dtype)
                parts.append((features.astype(np.int32), (sentence + sentences_so_far).astype(np.int32), (owner + texts_so_far).astype(np.int32)))
                sentences_so_far += len(owner)
                texts_so_far += end - first
        if parts:
            weights = train(*(np.concatenate(x) for x in zip(*parts)), np.concatenate(labels), seen, toxic)
            yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary())], ["weights"])

    found = rows.coalesce(1).mapInArrow(task, "weights binary").collect()
    if not found:
        return np.append(np.zeros(1 << BITS, np.float32), np.float32(START)).astype(np.float32)
    return np.frombuffer(bytes(found[0]["weights"]), np.float32)


def scored(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id, score, worst (the number of the sentence likeliest to offend, from 0) and worst_score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    @blocks.frugal
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            texts = blocks.encoded(batch.column("text"))
            score, worst, worst_score = np.zeros(len(texts)), np.full(len(texts), -1), np.zeros(len(texts))
            for first, end in blocks.pieces(texts):
                features, sentence, owner = sentences(texts[first:end])
                z = np.bincount(sentence, w[features], len(owner)) + w[-1]
                score[first:end] = -np.expm1(-np.bincount(owner, np.logaddexp(0, z), end - first))
                if len(owner):
                    order = np.lexsort((-z, owner))
                    lead = order[np.concatenate([[True], np.diff(owner[order]) > 0])]
                    begins = np.searchsorted(owner, owner[lead])
                    worst[first + owner[lead]] = lead - begins
                    worst_score[first + owner[lead]] = 1 / (1 + np.exp(-z[lead]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.clip(score, 0, 1)), pa.array(worst.astype(np.int32)), pa.array(worst_score)], ["doc_id", "score", "worst", "worst_score"])

    return docs.select("doc_id", "text").mapInArrow(task, "doc_id long, score double, worst int, worst_score double")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity score, learned from the labels of four of five folds."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").where(~held_out(F.col("doc_id")))
    got = scored(docs, fitted(docs, labels))
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "worst", "worst_score")


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows whose score is 0.5 or more; same columns. Learns from the labels of all but the held-out fold."""
    weights = fitted(docs, labels.where(~held_out(F.col("doc_id"))))
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    @blocks.frugal
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            texts = blocks.encoded(batch.column("text"))
            keep = np.ones(len(texts), bool)
            for first, end in blocks.pieces(texts):
                features, sentence, owner = sentences(texts[first:end])
                z = np.bincount(sentence, w[features], len(owner)) + w[-1]
                keep[first:end] = -np.expm1(-np.bincount(owner, np.logaddexp(0, z), end - first)) < 0.5
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(task, docs.schema)
