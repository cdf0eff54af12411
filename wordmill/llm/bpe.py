"""Byte-level BPE encoding and decoding with a global shuffle of distinct words.

1. Texts are cut into pre-tokens with positions. A block (some megabytes of texts, cut in
   pieces) lists its distinct pre-tokens; the list is dealt into ranges of the words'
   hashes, some for each shuffle partition, and what a block has of a range is packed
   into one row.
2. Rows are shuffled by range, so that all places of a word meet: each distinct word is
   encoded once. A word with ``HOT`` positions or more in one block is encoded there, once
   for that block, so no word is a hot key, however frequent.
3. Ids go back to their blocks, where they meet the positions of the words (differences
   of few bytes, in the same order) and are reassembled by position. Positions are cut a
   second time and go straight to the block: they are most of the bytes, and this way
   are shuffled once. Sums of hashes tell that both cuts agree. A position that no word
   fills is an error, too.
4. Decoding joins ids with the table of token bytes (as large as the vocabulary, whatever
   the corpus), by place.

Texts themselves are never shuffled, and nothing that grows is broadcast. A block's name
is made of the partition and the order of its rows, so ``docs`` must be a table that reads
alike again, as files do.

Pre-tokens are found on arrays of code points by character classes, which gives what
the vocabulary's pattern gives: a contraction; a run of letters, of digits or of other
signs, each with one space before it; white space up to the last before a sign.

Defined cases: a null text counts as empty and has no ids; repeated rows, also of one
doc_id, give a row each; a null doc_id is kept; an empty table gives an empty table;
bytes that aren't UTF-8 count as U+FFFD; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordmill.llm import blocks
from wordmill.llm.shared import modest

#: Positions in a block from which a word is encoded in the block itself, and bytes of text in a block.
HOT, BLOCK = 256, 4 << 20
#: Bytes of text that are cut at once.
PART = 1 << 18
#: Ranges of hashes for each shuffle partition.
RANGES = 4
ROW, ROWS = ["block", "range", "check", "rows", "docs"], "block long, range int, check long, rows binary, docs binary"

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
# Fixed value: the pattern that ``pre_tokens`` follows.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPACES, LETTER, DIGIT, SIGN = range(4)


@cache
def classes() -> np.ndarray:
    """The class of each code point by the library's own tables: what its pattern language calls letter, digit and space."""
    import tiktoken

    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    table = np.full(0x110000, SIGN, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (DIGIT, r"\p{N}"), (SPACES, r"\s")):
        # an encoding skips what its pattern doesn't match, so that only the class's characters come back
        only = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        table[np.frombuffer(bytes(only.encode_ordinary(every)).decode().encode("utf-32-le"), np.uint32)] = kind
    return table


def pre_tokens(points: np.ndarray, lengths: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Where pre-tokens start in the joined code points of several texts of the given lengths."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = table[points]
    first = np.zeros(n + 1, bool)  # text starts, and the end
    first[np.cumsum(lengths) - lengths] = True
    first[n] = True
    start = first[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    runs = np.flatnonzero(start)
    ends = np.append(runs[1:], n)
    # white space before a sign of the same text: its last character stands apart, or, a space, joins what follows
    before = (kind[runs] == SPACES) & ~first[ends]
    last = ends[before] - 1
    start[last] = True
    start[ends[before][points[last] == 0x20]] = False
    # contractions: an apostrophe that starts a pre-token, alone, before letters
    lone = (points[runs] == 0x27) & (ends - runs == 1) & start[runs] & ~first[ends]
    where = np.flatnonzero(lone)
    where = where[kind[ends[where]] == LETTER]
    at, stop = runs[where], ends[where + 1] if len(where) else ends[:0]
    one = points[at + 1]
    two = np.where(at + 2 < stop, points[np.minimum(at + 2, n - 1)], 0)
    short = np.isin(one, [*b"stmd"])
    long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
    for hit, width in ((short, 1), (long, 2)):
        start[at[hit] + 1] = False
        rest = at[hit] + 1 + width
        start[rest[rest < stop[hit]]] = True
    return np.flatnonzero(start)


class Piece:
    """Some texts, their pre-tokens, and the distinct ones among these."""

    def __init__(self, texts: list[bytes | None], table: np.ndarray):
        text = [t.decode("utf-8", "replace") if t else "" for t in texts]
        self.text = "".join(text)
        points = np.frombuffer(self.text.encode("utf-32-le"), np.uint32)
        self.lengths = np.fromiter(map(len, text), np.int64, len(text))
        self.starts = pre_tokens(points, self.lengths, table)
        self.ends = np.append(self.starts[1:], len(points)) if len(self.starts) else self.starts
        self.hashes = blocks.slice_hashes(points, self.starts, self.ends)
        self.distinct, self.example, self.which, self.counts = np.unique(self.hashes, return_index=True, return_inverse=True, return_counts=True)
        # another hash must agree on what is equal
        self.second = blocks.slice_hashes(points + np.uint32(7), self.starts, self.ends, blocks.SECOND)
        if not np.array_equal(self.second[self.example][self.which], self.second):
            raise ArithmeticError("two pre-tokens have one hash")

    def document(self) -> np.ndarray:
        """The number of the text of each pre-token."""
        return np.searchsorted(np.cumsum(self.lengths), self.starts, side="right")


@cache
def _encoder(vocabulary: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("words", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})


def vocabulary_bytes(name: str = VOCABULARY) -> bytes:
    """The rank file of a public tokenizer, read on the driver; executors get it by broadcast."""
    import public_tokenizers

    if public_tokenizers.PATTERN != PATTERN:
        raise ValueError("the vocabulary's pattern is not the one that texts are cut by")
    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def _gather(flat: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """flat[begins[i] : begins[i] + sizes[i]] for all i, joined."""
    ends = np.cumsum(sizes)
    return flat[np.repeat(begins - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


def packed(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers below 2**35 in bytes of seven bits, the lowest first, and how many bytes each takes."""
    x = numbers.astype(np.uint64)
    sizes = np.ones(len(x), np.int64)
    for bits in (7, 14, 21, 28):
        sizes += x >= (1 << bits)
    begins = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint8)
    for k in range(5):
        at = np.flatnonzero(sizes > k)
        more = np.where(sizes[at] > k + 1, 128, 0).astype(np.uint8)
        out[begins[at] + k] = ((x[at] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | more
    return out, sizes


def unpacked(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers that ``packed`` gave bytes for, and where each one's bytes end."""
    ends = np.flatnonzero(data < 128) + 1
    begins = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    out = np.zeros(len(ends), np.int64)
    for k in range(5):
        at = np.flatnonzero(ends - begins > k)
        out[at] |= (data[begins[at] + k].astype(np.int64) & 127) << (7 * k)
    return out, ends


def _binary(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """An array of byte strings of the given sizes, cut from one."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(flat))])


Strings = tuple[np.ndarray, np.ndarray]  # the bytes of several strings, joined, and the size of each


def word_rows(texts: list[bytes | None], table: np.ndarray) -> tuple[Strings, np.ndarray, np.ndarray, Strings, np.ndarray]:
    """Of a block's texts: the distinct pre-tokens, their hashes, how often and where each stands, and the pre-tokens of each text."""
    hashes, seconds, counts, places, words, sizes, per_text = [], [], [], [], [], [], []
    total = 0
    for first, end in blocks.pieces(texts, PART):
        piece = Piece(texts[first:end], table)
        per_text.append(np.bincount(piece.document(), minlength=end - first))
        hashes.append(piece.distinct)
        seconds.append(piece.second[piece.example])
        counts.append(piece.counts)
        places.append(np.argsort(piece.which, kind="stable") + total)
        points = np.frombuffer(piece.text.encode("utf-32-le"), np.uint32)
        width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        at = np.concatenate([[0], np.cumsum(width)])
        begin, stop = at[piece.starts[piece.example]], at[piece.ends[piece.example]]
        words.append(_gather(np.frombuffer(piece.text.encode(), np.uint8), begin, stop - begin))
        sizes.append(stop - begin)
        total += len(piece.starts)
    none = np.zeros(0, np.int64)
    join = lambda x: np.concatenate(x) if x else none
    hashes, seconds, counts, places, sizes = map(join, (hashes, seconds, counts, places, sizes))
    distinct, example, which = np.unique(hashes, return_index=True, return_inverse=True)
    if not np.array_equal(seconds[example][which], seconds):
        raise ArithmeticError("two pre-tokens have one hash")
    # what the pieces have of one word, in their order, so that positions go up
    order = np.argsort(which, kind="stable")
    begins = np.cumsum(counts) - counts
    spots = _gather(places, begins[order], counts[order])
    n = np.bincount(which, counts, len(distinct)).astype(np.int64)
    heads = np.cumsum(n) - n
    steps = np.diff(spots, prepend=0)
    steps[heads] = spots[heads]
    data, lengths = packed(steps)
    word_begins = np.cumsum(sizes) - sizes
    word = _gather(join(words).astype(np.uint8), word_begins[example], sizes[example]), sizes[example]
    where = data, np.add.reduceat(lengths, heads) if len(heads) else lengths
    return word, distinct.astype(np.uint64), n, where, join(per_text).astype(np.int64)


def taken(strings: Strings, at: np.ndarray) -> Strings:
    flat, sizes = strings
    return _gather(flat, (np.cumsum(sizes) - sizes)[at], sizes[at]), sizes[at]


def _texts(strings: Strings) -> list[bytes]:
    return _binary(*strings).to_pylist()


def first_bytes(strings: Strings) -> np.ndarray:
    """The first eight bytes of each string as a number: close numbers make neighbours that compress well."""
    flat, sizes = strings
    begins = np.cumsum(sizes) - sizes
    out = np.zeros(len(sizes), np.uint64)
    padded = np.append(flat, np.zeros(8, np.uint8)).astype(np.uint64)
    for k in range(8):
        out = out << np.uint64(8) | np.where(sizes > k, padded[begins + k], np.uint64(0))
    return out


def _encoded(words: list[bytes], encoder, kind) -> Strings:
    found = [encoder._encode_single_piece(w) for w in words]
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    flat = np.fromiter((i for x in found for i in x), kind, int(sizes.sum()))
    return flat.view(np.uint8), sizes * flat.itemsize


def _stream(batch: pa.RecordBatch) -> bytes:
    """A batch as bytes, compressed."""
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as stream:
        stream.write_batch(batch)
    return out.getvalue().to_pybytes()


def _batch(data: bytes) -> pa.RecordBatch:
    return next(iter(pa.ipc.open_stream(data)))


def bundle(**columns: Strings) -> bytes:
    """Strings under names as bytes, compressed; sizes as small numbers, which compress better than offsets."""
    parts = {k: x for name, (flat, sizes) in columns.items() for k, x in ((name, flat), (f"{name} sizes", packed(sizes)[0]))}
    return _stream(pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in parts.values()], list(parts)))


def unbundled(data: bytes) -> dict[str, Strings]:
    batch = _batch(data)
    whole = {name: np.frombuffer(batch.column(name)[0].as_py(), np.uint8) for name in batch.schema.names}
    return {name: (flat, unpacked(whole[f"{name} sizes"])[0]) for name, flat in whole.items() if not name.endswith(" sizes")}


def joined(rows: pa.Table, kind) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray]:
    """Of a block's rows: its documents, all ids by position, and how many each position has."""
    homes, checks, data, docs = (rows.column(c).to_pylist() for c in ("range", "check", "rows", "docs"))
    whole = homes.index(-1)
    own = unbundled(data[whole])
    parts = own["parts"][0].view(np.int64).reshape(3, -1)
    order = sorted((i for i in range(len(homes)) if i != whole), key=lambda i: homes[i])
    ids = [unbundled(data[i])["ids"] for i in order]
    if [(homes[i], len(x[1]), checks[i]) for i, x in zip(order, ids)] != [tuple(x) for x in parts.T.tolist()]:
        raise ArithmeticError("a block was cut into different words the second time")
    every = tuple(np.concatenate([np.zeros(0, d), *(x[k] for x in ids)]) for k, d in ((0, np.uint8), (1, np.int64)))
    documents = _batch(docs[whole])
    return documents, *reassembled(documents, [{"spots": own["spots"], "ids": every}, {"spots": own["known_spots"], "ids": own["known_ids"]}], kind)


def reassembled(documents: pa.RecordBatch, rows: list[dict[str, Strings]], kind) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a block by position, and how many each position has, from ``spots`` and ``ids``."""
    every = lambda name, i: np.concatenate([r[name][i] for r in rows])
    spots, spot_ends = every("spots", 0), np.concatenate([[0], np.cumsum(every("spots", 1))])
    flat, begins = every("ids", 0).view(kind), np.concatenate([[0], np.cumsum(every("ids", 1))]) // np.dtype(kind).itemsize
    steps, ends = unpacked(spots)
    counts = np.diff(np.searchsorted(ends, spot_ends, side="right"))
    sums = np.cumsum(steps)
    before = np.concatenate([[0], sums])[np.cumsum(counts) - counts]
    at = sums - np.repeat(before, counts)
    n = int(documents.column("n").to_numpy().sum())
    row = np.full(n, -1, np.int64)
    row[at] = np.repeat(np.arange(len(counts)), counts)
    if len(at) != n or (row < 0).any():
        raise ArithmeticError("a position has no word")
    sizes = np.diff(begins)[row]
    return _gather(flat, begins[:-1][row], sizes).astype(np.uint32), sizes


def encode(docs: DataFrame, vocabulary: bytes, hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """doc_id, n_tokens, ids, ids_sha256, decoded_sha256 of every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    modest(spark)
    # both as large as the vocabulary and the code points, whatever the corpus
    ranks, kinds = spark.sparkContext.broadcast(vocabulary), spark.sparkContext.broadcast(classes())
    kind = np.uint16 if _encoder(vocabulary).n_vocab <= 1 << 16 else np.uint32

    ranges = RANGES * max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def listed(batches: Iterator[pa.RecordBatch]):
        """Each block's name, documents, words and where they stand; the words to encode elsewhere and their ranges."""
        number = None
        for batch in batches:
            if number is None:
                number = batch.column("part")[0].as_py() << 32
            texts = blocks.encoded(batch.column("text"))
            for first, end in blocks.pieces(texts, block):
                word, hashes, n, where, per_text = word_rows(texts[first:end], kinds.value)
                rare = np.flatnonzero(n < hot)
                home = ((hashes[rare] >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
                order = np.lexsort((first_bytes(taken(word, rare)), home))
                rare, home = rare[order], home[order]
                heads = np.flatnonzero(np.diff(home, prepend=-1))
                checks = np.add.reduceat(hashes[rare], heads).view(np.int64) if len(heads) else np.zeros(0, np.int64)
                documents = pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, end - first).cast(pa.int64()), pa.array(per_text)], ["doc_id", "n"])
                yield number, documents, word, n, where, rare, home[heads], np.append(heads, len(rare)), checks
                number += 1
                blocks.trim()

    @blocks.frugal
    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, _, word, _, _, rare, homes, cuts, checks in listed(batches):
            data = [bundle(words=taken(word, rare[b:e])) for b, e in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(data), pa.int64()), pa.array(homes.astype(np.int32)), pa.array(checks), pa.array(data, pa.binary()), pa.nulls(len(data), pa.binary())], ROW)

    @blocks.frugal
    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(ranks.value)
        for name, documents, word, n, where, rare, homes, cuts, checks in listed(batches):
            often = np.flatnonzero(n >= hot)
            parts = np.stack([homes, np.diff(cuts), checks]) if len(homes) else np.zeros((3, 0), np.int64)
            whole = bundle(
                spots=taken(where, rare), parts=(parts.astype(np.int64).ravel().view(np.uint8), np.full(parts.size, 8)), known_spots=taken(where, often), known_ids=_encoded(_texts(taken(word, often)), encoder, kind)
            )
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([-1], pa.int32()), pa.array([0], pa.int64()), pa.array([whole], pa.binary()), pa.array([_stream(documents)], pa.binary())], ROW)

    @blocks.frugal
    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_one = _encoder(ranks.value)._encode_single_piece
        last, ids_of = None, {}
        for batch in batches:
            out = []
            for home, data in zip(batch.column("range").to_pylist(), batch.column("rows").to_pylist()):
                if home != last:  # all rows of a range come one after the other
                    last, ids_of = home, {}
                found = _texts(unbundled(data)["words"])
                for w in found:
                    if w not in ids_of:
                        ids_of[w] = np.array(encode_one(w), kind).tobytes()
                ids = [ids_of[w] for w in found]
                out.append(bundle(ids=(np.frombuffer(b"".join(ids), np.uint8), np.fromiter(map(len, ids), np.int64, len(ids)))))
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("range"), batch.column("check"), pa.array(out, pa.binary()), batch.column("docs")], ROW)

    def assembled(rows: pa.Table) -> pa.Table:
        encoder = _encoder(ranks.value)
        token_bytes = [encoder.decode_single_token_bytes(i) for i in range(encoder.n_vocab)]
        token_sizes = np.fromiter(map(len, token_bytes), np.int64, len(token_bytes))
        token_begins = np.cumsum(token_sizes) - token_sizes
        token_flat = np.frombuffer(b"".join(token_bytes), np.uint8)
        documents, ids, sizes = joined(rows, kind)
        cuts = np.concatenate([[0], np.cumsum(documents.column("n").to_numpy())])
        stops = np.concatenate([[0], np.cumsum(sizes)])[cuts]
        raw = memoryview(ids.astype("<u4")).cast("B")
        sha, back = [], []
        for b, e in zip(stops[:-1].tolist(), stops[1:].tolist()):
            sha.append(hashlib.sha256(raw[4 * b : 4 * e]).hexdigest())
            back.append(hashlib.sha256(_gather(token_flat, token_begins[ids[b:e]], token_sizes[ids[b:e]]).tobytes()).hexdigest())
        lists = pa.ListArray.from_arrays(pa.array(stops, pa.int32()), pa.array(ids.astype(np.int32)))
        blocks.trim()
        return pa.table([documents.column("doc_id"), pa.array(np.diff(stops)), lists, pa.array(sha, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"])

    own = docs.select("doc_id", "text", F.spark_partition_id().alias("part"))
    told = own.mapInArrow(words, ROWS).repartition("range").sortWithinPartitions("range").mapInArrow(once, ROWS)
    both = told.union(own.mapInArrow(positions, ROWS))
    return both.groupBy("block").applyInArrow(assembled, "doc_id long, n_tokens long, ids array<int>, ids_sha256 string, decoded_sha256 string")


def decode(ids: list[int], vocabulary: bytes) -> bytes:
    """The bytes of a list of ids."""
    return _encoder(vocabulary).decode_bytes(ids)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of ids, and digests of its ids and of what they decode to."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode(docs, vocabulary_bytes()).drop("ids")

