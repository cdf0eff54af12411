"""Best-fit packing of documents into sequences of a fixed number of tokens.

A document's ids, with one id behind them that ends it, are a piece; only a longer
document is cut, into pieces of a whole sequence each, but for a shorter first one.
Best-fit decreasing takes pieces from the longest to the shortest and puts each into the
open sequence whose remaining room is tightest, or opens a new one.

1. One pass over the texts gives the pieces, their lengths and their places among the
   pieces of the same length and block of input. Pieces are written as a table.
2. Pieces of one length are interchangeable, so all that best fit needs to know of the
   corpus is how many pieces each length has: at most ``capacity`` counts, whatever the
   corpus. A segment tree over remaining rooms finds the tightest open one in logarithmic
   time, for a run of equal pieces at once: from a room c, pieces of length s go on going
   into the same sequence until what is left is below s, since that is then the tightest.
   Sequences that were filled alike stay one run of numbers; the result is the very one
   that taking piece after piece gives (tested).
3. Each piece gets its number among all pieces of its length, from running sums over
   blocks, and by that its sequence and its place there. Pieces are shuffled once, without
   their ids, on block and length, of which none is hot; the plan is a few rows for each
   length.

Words are cut as the tokenizer cuts them, and each distinct one is encoded once in a
worker's table of bounded size: by the tokenizer, or, where its merges give ids in rising
order, by merging the pair of the least id first, which is the same and faster for short
words. Texts with characters on which the pattern's engines
differ, or with the name of a special token (which the tokenizer takes for that token, as
it does by default), are encoded whole; long texts are cut where a single space stands
between two other characters, which is always a border of words.

Defined cases: a null or empty text is its end id alone; repeated rows, also of one
doc_id, are documents of their own; a null doc_id is kept, a doc_id may have any type; an
empty table gives an empty table; other columns are ignored; a text of any length is
encoded whole, a million characters at once. ``docs`` must be a table that reads alike
again, as files do. Ties (pieces of one length, sequences of one room) are broken by block
and place in it, so that reruns over the same files agree.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wordmill.llm import blocks
from wordmill.llm.shared import modest, written

CAPACITY, END, VOCABULARY = 2048, 0, "byte_bpe_50k.json"
#: Characters that are cut into words at once; words that a worker keeps, and the longest of these.
AT_ONCE, KEPT, LONGEST = 1 << 20, 1 << 19, 64
# Fixed value: the pattern that the tokenizer cuts words by.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Rooms:
    """How many open sequences have each remaining room: a segment tree, whose node is the sum of its two children."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.sums = [0] * (2 * self.leaves)

    def add(self, room: int, n: int) -> None:
        at = self.leaves + room
        while at:
            self.sums[at] += n
            at >>= 1

    def tightest(self, need: int) -> int | None:
        """The smallest room of ``need`` or more that an open sequence has."""
        at = self.leaves + need
        if self.sums[at]:
            return need
        while at > 1 and (at & 1 or not self.sums[at + 1]):  # up, until something stands to the right
            at >>= 1
        if at <= 1:
            return None
        at += 1
        while at < self.leaves:
            at = 2 * at if self.sums[2 * at] else 2 * at + 1
        return at - self.leaves


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Best-fit decreasing of so many pieces of each length: rows (length, rank, each, first, offset).

    Of the pieces of ``length``, those from ``rank`` on (until the next row's rank) go by
    ``each`` into one sequence after the other, from number ``first`` on, where they start at ``offset``.
    """
    rooms, runs = Rooms(capacity), {}
    plan, opened = [], 0

    def put(room: int, first: int, n: int) -> None:
        if n and room:
            rooms.add(room, n)
            runs.setdefault(room, []).append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = rooms.tightest(length)
            if room is None:
                room = capacity
                first, n = opened, -(-left // (capacity // length))
                opened += n
            else:
                first, n = runs[room].pop()
                rooms.add(room, -n)
            each = room // length
            for share, m in ((each, min(n, left // each)), (left % each, int(left // each < n and left % each > 0))):
                if m:
                    plan.append((length, rank, share, first, capacity - room))
                    put(room - share * length, first, m)
                    rank, left, first, n = rank + share * m, left - share * m, first + m, n - m
            put(room, first, n)
    return np.array(plan, np.int64).reshape(-1, 5)


def placed(plan: np.ndarray, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sequence and the offset of the pieces of these lengths and ranks; ``plan`` is sorted by length and rank."""
    at = np.searchsorted((plan[:, 0] << 50) + plan[:, 1], (lengths << 50) + ranks, side="right") - 1
    _, rank, each, first, offset = plan[at].T
    return first + (ranks - rank) // each, offset + (ranks - rank) % each * lengths


@cache
def engines() -> tuple[str, str]:
    """The characters on which the tokenizer's pattern engine and ours differ (newer ones, mostly), as the inside of a character class; and the pattern for Latin-1 texts, its classes spelled out."""
    import regex
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    odd = np.zeros(len(every) + 1, np.int64)
    latin = PATTERN
    for kind in (r"\p{L}", r"\p{N}", r"\s"):
        theirs, ours = np.zeros(len(every) + 1, np.int64), np.zeros(len(every) + 1, np.int64)
        for _, (first, end) in Split(Regex(f"[^{kind}]+"), "removed").pre_tokenize_str(every):
            theirs[first:end] = 1
        for m in regex.finditer(f"{kind}+", every):
            ours[m.start() : m.end()] = 1
        odd |= theirs ^ ours
        listed = "".join(f"\\x{c:02x}" for c in np.flatnonzero(theirs[:256]).tolist())
        latin = latin.replace(r"\S", f"[^{listed}]") if kind == r"\s" else latin
        latin = latin.replace(f"{kind}+", f"[{listed}]+").replace(kind, listed)
    edges = np.flatnonzero(np.diff(odd, prepend=0))
    return "".join(f"\\U{ord(every[a]):08x}-\\U{ord(every[b - 1]):08x}" for a, b in zip(edges[::2].tolist(), edges[1::2].tolist())), latin


def merge_ranks(source: str) -> dict[bytes, int] | None:
    """The ids of all byte strings, if merging by the least id is what the tokenizer does: its merges give ids in rising order."""
    model = json.loads(source)["model"]
    vocabulary = model["vocab"]
    made = [vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    if any(a >= b for a, b in zip(made, made[1:])) or model.get("ignore_merges") or model.get("dropout"):
        return None
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # bytes that stand for themselves; the others follow from 256 on
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    return {bytes(byte[c] for c in word): i for word, i in vocabulary.items() if all(c in byte for c in word)}


class Encoder:
    """Texts to ids as four bytes each; words that were met stay, up to ``KEPT`` of them."""

    def __init__(self, source: str, odd: str, latin: str):
        import re

        import regex
        import tiktoken
        import tokenizers

        self.tokenizer = tokenizers.Tokenizer.from_str(source)
        self.words, self.latin_words = regex.compile(PATTERN).findall, re.compile(latin).findall
        self.border = regex.compile(r"(?<=\S) (?=\S)").search
        self.odd = regex.compile(f"[{odd}]").search if odd else lambda text: None
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        ranks = merge_ranks(source)
        self.short = ranks and tiktoken.Encoding("words", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})._encode_single_piece
        self.known: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, words: set[str]) -> None:
        """Encodes words that aren't known yet."""
        new = words.difference(self.known)
        if len(self.known) + len(new) > KEPT:
            self.known, new = {}, words
        new = [w for w in new if len(w) <= LONGEST]
        self.known.update(zip(new, (array("I", self.short(w)).tobytes() for w in new) if self.short else self._whole(new)))

    def __call__(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of each text; texts of some megabytes together."""
        cut = [self._cut(t) if t else [] for t in texts]
        self.learn(set().union(*(words for words in cut if words is not None)))
        known = self.known
        for text, words in zip(texts, cut):
            if words is None:
                yield self._whole([text])[0]
                continue
            try:
                yield b"".join(map(known.__getitem__, words))
            except KeyError:  # very long words aren't kept
                yield b"".join(known[w] if w in known else self._whole([w])[0] for w in words)

    def _cut(self, text: str) -> list[str] | None:
        if any(name in text for name in self.special):
            return None
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return None if self.odd(text) else self.words(text)
        return self.latin_words(text)

    def parts(self, text: str | None) -> Iterator[str | None]:
        """A long text in parts that are encoded like the whole."""
        first = 0
        while text and len(text) - first > AT_ONCE and (found := self.border(text, first + AT_ONCE)):
            yield text[first : found.start()]
            first = found.start()
        yield text[first:] if first else text


@cache
def _encoder(source: str, odd: str, latin: str) -> Encoder:
    """A worker's encoder, whose words serve its later tasks, too."""
    return Encoder(source, odd, latin)


def tokenizer_source(name: str = VOCABULARY) -> str:
    """The file of a public tokenizer, read on the driver; executors get it by broadcast."""
    import public_tokenizers

    if public_tokenizers.PATTERN != PATTERN:
        raise ValueError("the tokenizer's pattern is not the one that texts are cut by")
    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


def pieces(docs: DataFrame, source: str, capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, block, within (and ids) of every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    modest(spark)
    shared = spark.sparkContext.broadcast((source, *engines()))  # as large as the vocabulary
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, block int, within long" + ", ids array<int>" * ids
    end = np.array([END], "<u4").tobytes()

    @blocks.frugal
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives a task one core
        encoder = _encoder(*shared.value)
        met = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            rows, piece, starts, lengths, sums, flat = [], [], [], [], [], []
            texts = batch.column("text").to_pylist()
            parts = [list(encoder.parts(t)) for t in texts]
            at = 0
            short = [p[0] for p in parts if len(p) == 1]
            encoded = iter(encoder(short))
            for row, own in enumerate(parts):
                found = next(encoded) if len(own) == 1 else b"".join(x for p in own for x in encoder([p]))
                data = memoryview(found + end)
                n = len(data) // 4
                at = n % capacity or capacity
                for k, (a, b) in enumerate(zip([0, *range(at, n, capacity)], range(at, n + 1, capacity))):
                    rows.append(row)
                    piece.append(k)
                    starts.append(a)
                    lengths.append(b - a)
                    sums.append(zlib.crc32(data[4 * a : 4 * b]))
                    if ids:
                        flat.append(np.frombuffer(data[4 * a : 4 * b], "<u4").astype(np.int32))
            size = np.array(lengths, np.int64)
            order = np.argsort(size, kind="stable")
            heads = np.flatnonzero(np.diff(size[order], prepend=-1))
            within = np.empty(len(size), np.int64)
            within[order] = np.arange(len(size)) - np.repeat(heads, np.diff(np.append(heads, len(size))))
            within += met[size]
            met += np.bincount(size, minlength=capacity + 1)
            columns = [batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(starts, pa.int64()), pa.array(size), pa.array(sums, pa.int64())]
            columns += [batch.column("block").take(pa.array(rows, pa.int64())), pa.array(within)]
            columns += [pa.array(flat, pa.list_(pa.int32()))] * ids
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "block", "within"] + ["ids"] * ids)

    return docs.select("doc_id", "text", F.spark_partition_id().alias("block")).mapInArrow(task, schema)


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The columns of ``found`` (a written table of ``pieces``) without block and within, and sequence_id and offset."""
    spark = found.sparkSession
    counts = written(spark, found.groupBy("length", "block").agg(F.count(F.lit(1)).alias("n")), "lengths", packed=True)
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # at most ``capacity`` rows
    plan = best_fit({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    shared = spark.sparkContext.broadcast(plan[np.lexsort((plan[:, 1], plan[:, 0]))])
    names = [c for c in found.columns if c not in ("block", "within")]
    ranked = found.hint("merge").join(bases, ["length", "block"]).select(*names, (F.col("base") + F.col("within")).alias("rank"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = placed(shared.value, batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"{c} {found.schema[c].dataType.simpleString()}" for c in names)
    return ranked.mapInArrow(task, f"{schema}, sequence_id long, offset long")


def sequences(docs: DataFrame, source: str, capacity: int = CAPACITY) -> DataFrame:
    """sequence_id, ids, doc_ids: the packed sequences themselves; each holds ``capacity`` ids at most, which bounds its row."""
    found = pack(written(docs.sparkSession, pieces(docs, source, capacity, ids=True), "pieces"), capacity)
    rows = found.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id"))).alias("rows"))
    return rows.select("sequence_id", F.flatten("rows.ids").alias("ids"), F.col("rows.doc_id").alias("doc_ids"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document, its sequence and its place there."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(written(spark, pieces(docs, tokenizer_source()), "pieces"))
