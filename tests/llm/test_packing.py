"""Best-fit packing against the tokenizer itself and piece after piece."""

import zlib
from collections import Counter
from functools import cache

import numpy as np
import pytest

from wordmill.llm import packing
from wordmill.llm.shared import written


def plain_best_fit(lengths, capacity):
    """How full the bins are when each piece, the longest first, goes where room is tightest; which of equally full ones it takes makes no difference."""
    bins = []
    for s in sorted(lengths, reverse=True):
        fits = [b for b in bins if capacity - sum(b) >= s]
        if fits:
            max(fits, key=sum).append(s)
        else:
            bins.append([s])
    return Counter(map(sum, bins))


def planned(counts, capacity):
    plan = packing.best_fit(counts, capacity)
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    lengths = np.repeat(list(counts), list(counts.values())).astype(np.int64)
    ranks = np.concatenate([np.arange(n) for n in counts.values()])
    return lengths, *packing.placed(plan, lengths, ranks)


@pytest.mark.parametrize("seed", range(40))
def test_runs_of_equal_pieces_equal_piece_after_piece(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.integers(1, 60))
    lengths = rng.integers(1, capacity + 1, int(rng.integers(1, 300)))
    if seed % 3 == 0:  # many of one length
        lengths = np.concatenate([lengths, np.full(100, lengths[0])])
    size, bins, offsets = planned(dict(Counter(lengths.tolist())), capacity)
    made = {}
    for b, o, s in sorted(zip(bins.tolist(), offsets.tolist(), size.tolist())):
        assert o == sum(made.setdefault(b, []))  # gapless from 0
        made[b].append(s)
    assert sorted(made) == list(range(len(made)))
    assert max(map(sum, made.values())) <= capacity
    assert Counter(map(sum, made.values())) == plain_best_fit(lengths.tolist(), capacity)


def test_tightest_room():
    rooms = packing.Rooms(10)
    assert rooms.tightest(1) is None
    for r in (3, 7, 10):
        rooms.add(r, 2)
    assert [rooms.tightest(n) for n in (1, 3, 4, 7, 8, 10)] == [3, 3, 7, 7, 10, 10]
    rooms.add(10, -2)
    assert rooms.tightest(8) is None


def test_characters_on_which_engines_differ():
    """Each character is either named as differing or cut alike, behind letters, digits, signs and spaces."""
    import regex
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(packing.tokenizer_source())
    odd = regex.compile(f"[{packing.engines()[0]}]")
    every = [c for c in map(chr, range(0x110000)) if not 0xD800 <= ord(c) < 0xE000 and not odd.match(c)]
    assert len(every) > 1_090_000 and not odd.search("".join(map(chr, range(0x530))))
    for i in range(0, len(every), 50_000):
        text = "".join(f"a{c}1{c}!{c} " for c in every[i : i + 50_000])
        assert [o for _, o in t.pre_tokenizer.pre_tokenize_str(text)] == [m.span() for m in regex.finditer(packing.PATTERN, text)]


def test_latin_texts_and_merges():
    """Latin-1 texts are cut alike by the spelled-out classes; short words are merged as the tokenizer does."""
    import re

    import regex

    rng = np.random.default_rng(2)
    latin = re.compile(packing.engines()[1])
    for _ in range(300):
        text = "".join(map(chr, rng.choice([*range(256), *b"  \n'stmdrvel"], 400)))
        assert latin.findall(text) == regex.findall(packing.PATTERN, text)
    encoder = packing.Encoder(packing.tokenizer_source(), *packing.engines())
    assert encoder.short
    words = {"".join(map(chr, rng.choice([*range(33, 591), *range(97, 123)], 1 + k % 40))) for k in range(3000)}
    texts = [w for w in words if not encoder.odd(w)]
    assert list(encoder(texts)) == [np.array(direct(t)[:-1], "<u4").tobytes() for t in texts]
    scrambled = packing.tokenizer_source().replace('"merges": [', '"merges": ["Ġ Ġ", ', 1)
    assert packing.merge_ranks(packing.tokenizer_source()) and ("Ġ Ġ" not in scrambled or packing.merge_ranks(scrambled) is None)


TEXTS = [None, "", " ", "a", "It's we'll  two\n\n three", "՘x ࢏1", "дом " * 3000, "x" * 5000, "word " * 4096, "ab　 cd\r\n", "<|endoftext|> end", "a" * 70 + " b", "end", "end"]


@pytest.fixture(scope="module")
def odd_rows(spark):
    return spark.createDataFrame([(i, t, "block") for i, t in enumerate(TEXTS)], "doc_id long, text string, block string").repartition(3, "doc_id")


@cache
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_str(packing.tokenizer_source())


def direct(text):
    return tokenizer().encode(text or "", add_special_tokens=False).ids + [0]


def test_pieces_and_sequences(spark, odd_rows, monkeypatch):
    table = written(spark, odd_rows, "docs")
    for capacity in (2048, 100):
        rows = packing.pack(written(spark, packing.pieces(table, packing.tokenizer_source(), capacity, ids=True), "pieces"), capacity).collect()
        by_doc, by_bin = {}, {}
        for r in rows:
            by_doc.setdefault(r["doc_id"], []).append(r)
            by_bin.setdefault(r["sequence_id"], []).append(r)
        for i, text in enumerate(TEXTS):
            ids, own = direct(text), sorted(by_doc[i], key=lambda r: r["piece"])
            assert [x for r in own for x in r["ids"]] == ids
            assert [r["piece"] for r in own] == list(range(len(own)))
            assert all(r["length"] == capacity for r in own[1:]) and own[0]["length"] == (len(ids) % capacity or capacity)
            for r in own:
                part = ids[r["start"] : r["start"] + r["length"]]
                assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
        assert sorted(by_bin) == list(range(len(by_bin)))
        for own in by_bin.values():
            at = 0
            for r in sorted(own, key=lambda r: r["offset"]):
                assert r["offset"] == at
                at += r["length"]
            assert at <= capacity
        assert Counter(sum(r["length"] for r in x) for x in by_bin.values()) == plain_best_fit([r["length"] for r in rows], capacity)
        want = {b: [x for r in sorted(own, key=lambda r: r["offset"]) for x in r["ids"]] for b, own in by_bin.items()}
        made = packing.sequences(table, packing.tokenizer_source(), capacity).collect()
        assert {r["sequence_id"]: r["ids"] for r in made} == want


def test_long_texts_in_parts():
    encoder = packing.Encoder(packing.tokenizer_source(), *packing.engines())
    text = "It's  a long\n text, of words " * 60_000 + "y" * 10
    parts = list(encoder.parts(text))
    assert len(parts) == 2 and "".join(parts) == text
    assert b"".join(x for p in parts for x in encoder([p])) == np.array(direct(text)[:-1], "<u4").tobytes()
    lone = "z" * (packing.AT_ONCE + 10)
    assert list(encoder.parts(lone)) == [lone]


def test_empty_table_and_other_ids(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(written(spark, packing.pieces(none, packing.tokenizer_source()), "pieces")).collect() == []
    named = written(spark, spark.createDataFrame([("a", "x y"), (None, None), ("a", "x y")], "doc_id string, text string"), "docs")
    got = packing.pack(written(spark, packing.pieces(named, packing.tokenizer_source()), "pieces")).collect()
    assert sorted((str(r["doc_id"]), r["length"], r["sequence_id"]) for r in got) == [("None", 1, 0), ("a", 3, 0), ("a", 3, 0)]


def test_query_packs_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = packing.op12_packing(spark, sf).collect()
    assert {r["doc_id"] for r in got} == set(docs)
    made = Counter()
    for r in got:
        made[r["doc_id"]] += r["length"]
    assert all(made[d] == len(direct(t)) for d, t in docs.items())
    bins = plain_best_fit([r["length"] for r in got], packing.CAPACITY)
    assert len({r["sequence_id"] for r in got}) == sum(bins.values())
