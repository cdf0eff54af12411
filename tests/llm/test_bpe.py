import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from wordmill.llm import bpe


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, bpe.vocabulary_bytes().splitlines())}
    return tiktoken.Encoding("whole", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def cut(text):
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    at = [*bpe.pre_tokens(points, np.array([len(text)]), bpe.classes()).tolist(), len(text)]
    return [text[a:b] for a, b in zip(at, at[1:])]


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("  \n\t\xa0　''ssttrevelldm'aZé1²٣!.-_中😀́")), max_size=14))
def test_cuts_as_the_pattern_does(text):
    assert cut(text) == regex.findall(public_tokenizers.PATTERN, text)


def test_every_character_as_the_library(reference):
    """All code points, each beside letters, digits, signs and spaces."""
    encode = bpe._encoder(bpe.vocabulary_bytes())._encode_single_piece
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    random.Random(1).shuffle(chars)
    texts = [f"a{c}a1{c}1{c}{c} {c}\n{c}!{c}" for c in chars]
    for k in range(0, len(texts), 50000):
        part = texts[k : k + 50000]
        joined = "".join(part)
        at = [*bpe.pre_tokens(np.frombuffer(joined.encode("utf-32-le"), np.uint32), np.array([len(t) for t in part]), bpe.classes()).tolist(), len(joined)]
        ids = [i for a, b in zip(at, at[1:]) for i in encode(joined[a:b].encode())]
        want = [i for x in reference.encode_ordinary_batch(part, num_threads=2) for i in x]
        assert ids == want


@pytest.mark.parametrize("hot,block", [(256, 8 << 20), (3, 2000), (1 << 30, 500)])
def test_whole_result(spark, reference, hot, block):
    r = random.Random(3)
    words = ["the", "it's", "they'll", "café", "中文", "😀", "x" * 90, "\n\n", "  ", "1999", "...", "don't", "'re", "a'b", "\xa0"]
    texts = [r.choice(["", " "]).join(r.choice(words) + r.choice(["", " ", chr(r.randrange(33, 0x3000))]) for _ in range(r.randrange(40))) for _ in range(300)]
    texts += [None, "", " ", "the " * 70000, "z" * 100000, "<|endoftext|>"]
    rows = [(i, t, "c") for i, t in enumerate(texts)] + [(3, texts[3], "c"), (3, "other", "c"), (None, "none", "c"), (None, None, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(4)
    got = bpe.encode(docs, bpe.vocabulary_bytes(), hot=hot, block=block).collect()
    want = []
    for i, t, _ in rows:
        ids = reference.encode_ordinary(t or "")
        want.append((str(i), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), ids))
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256, r.ids) for r in got) == sorted(want)
    assert bpe.decode(want[5][4], bpe.vocabulary_bytes()).decode() == texts[5]


def test_empty(spark):
    assert bpe.encode(spark.createDataFrame([], "doc_id long, text string"), bpe.vocabulary_bytes()).count() == 0


def test_another_pattern_is_refused(monkeypatch):
    monkeypatch.setattr(public_tokenizers, "PATTERN", public_tokenizers.PATTERN + "|x")
    with pytest.raises(ValueError, match="pattern"):
        bpe.vocabulary_bytes()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, (1 << 35) - 1)), max_size=40))
def test_packed_numbers_come_back(numbers):
    data, sizes = bpe.packed(np.array(numbers, np.int64))
    back, ends = bpe.unpacked(data)
    assert back.tolist() == numbers and ends.tolist() == np.cumsum(sizes).tolist()


@given(st.lists(st.binary(max_size=12), max_size=30))
def test_bundles_come_back(strings):
    own = np.frombuffer(b"".join(strings), np.uint8), np.array([len(x) for x in strings], np.int64)
    back = bpe.unbundled(bpe.bundle(a=own))["a"]
    assert bpe._texts(back) == strings
    order = np.argsort(bpe.first_bytes(own), kind="stable")
    assert [x[:8].ljust(8, b"\0") for x in bpe._texts(bpe.taken(own, order))] == sorted(x[:8].ljust(8, b"\0") for x in strings)


def test_a_missing_position_is_an_error():
    word, _, n, where, per_text = bpe.word_rows([b"a b a", None], bpe.classes())
    assert sorted(zip(bpe._texts(word), n.tolist())) == [(b" a", 1), (b" b", 1), (b"a", 1)] and per_text.tolist() == [3, 0]
    documents = bpe.pa.RecordBatch.from_arrays([bpe.pa.array([1, 2]), bpe.pa.array(per_text)], ["doc_id", "n"])
    ids = np.array([7, 8, 9], np.uint16).view(np.uint8), np.full(3, 2)
    found, sizes = bpe.reassembled(documents, [{"spots": where, "ids": ids}], np.uint16)
    assert sorted(found.tolist()) == [7, 8, 9] and sizes.tolist() == [1, 1, 1]
    few = {"spots": bpe.taken(where, np.arange(2)), "ids": bpe.taken(ids, np.arange(2))}
    with pytest.raises(ArithmeticError, match="no word"):
        bpe.reassembled(documents, [few], np.uint16)


def test_cuts_that_differ_are_an_error():
    text = [b"a b a"]
    word, hashes, n, where, per_text = bpe.word_rows(text, bpe.classes())
    documents = bpe.pa.RecordBatch.from_arrays([bpe.pa.array([1]), bpe.pa.array(per_text)], ["doc_id", "n"])
    ids = np.array([7, 8, 9], np.uint16).view(np.uint8), np.full(3, 2)
    none = np.zeros(0, np.uint8), np.zeros(0, np.int64)
    parts = np.array([[5], [3], [99]]).ravel().view(np.uint8), np.full(3, 8)
    whole = bpe.bundle(spots=where, parts=parts, known_spots=none, known_ids=none)
    rows = lambda check: bpe.pa.table({"range": [5, -1], "check": [check, 0], "rows": [bpe.bundle(ids=ids), whole], "docs": [None, bpe._stream(documents)]})
    assert sorted(bpe.joined(rows(99), np.uint16)[1].tolist()) == [7, 8, 9]
    with pytest.raises(ArithmeticError, match="different words"):
        bpe.joined(rows(98), np.uint16)
