"""Token ids, packing and wavelet shards against the library and plain counting."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from opsloom.llm import packing, wavelet
from opsloom.llm.tokens import Encoder, encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
FRESH = Tokenizer.from_file(PATH)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=" \n\tab.,'s1é漢Ġ  <|", max_size=12), max_size=4))
def test_parts_give_the_ids_of_the_whole(texts):
    own = encoder(PATH)
    assert [x.tolist() for x in own.encode(texts)] == [own.library.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", "hello", "world.", " ", "\n", ",", "<|", "|>", "é"]), max_size=9).map("".join))
def test_added_tokens_have_the_ids_of_the_file(text):
    assert encoder(PATH).encode([text, "hello <|endoftext|> world"])[0].tolist() == FRESH.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["word", "Ab", "word.", "it's", "é", "漢", "Ċ", "Ġ", "12", ".", "'s", "\n", " ", " ", "\n", "\t", "\x1c", "\u2028", "\xa0", "\0"]), max_size=12).map("".join))
def test_line_feeds_part_words_as_the_library_does(text):
    assert encoder(PATH).encode([text, text + "\n"])[0].tolist() == FRESH.encode(text, add_special_tokens=False).ids
    assert encoder(PATH).encode([text + "\n"])[0].tolist() == FRESH.encode(text + "\n", add_special_tokens=False).ids


def test_each_part_is_learned_once_whatever_line_it_ends():
    own = Encoder(PATH)
    text = " ".join(f"word{i % 7}.\nLine{i % 5} goes on" for i in range(100))
    assert own.encode([text])[0].tolist() == FRESH.encode(text, add_special_tokens=False).ids
    # 7 words before a line feed, 5 after it, "goes" and "on"
    assert len(own.kept) == 14


def test_the_ids_of_an_added_token():
    assert encoder(PATH).encode(["hello <|endoftext|> world"])[0].tolist() == [31373, 220, 50256, 995]


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr("opsloom.llm.tokens.MEMORY", 5)
    own = encoder(PATH)
    own.kept.clear()
    for i in range(20):
        text = f"some word{i} and another{i}."
        assert own.encode([text])[0].tolist() == own.library.encode(text, add_special_tokens=False).ids
        assert len(own.kept) <= 9


def ids_of(text, end):
    return encoder(PATH).library.encode(text or "", add_special_tokens=False).ids + [end]


def test_pieces_are_whole_and_windows_gapless(awkward):
    rows = packing.pack(awkward.repartition(3), PATH).collect()
    want = Counter((r.doc_id, tuple(ids_of(r.text, 0))) for r in awkward.collect())
    windows, docs = {}, {}
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length > 0
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
        docs.setdefault(r.doc_id, []).append((r.start, ids, r.doc_tokens))
    for pieces in windows.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == 1024 or at & (at - 1) == 0  # nothing is padded
    assert sum(len(x) * n for (_, x), n in want.items()) == sum(len(i) for d in docs.values() for _, i, _ in d)
    long = sorted(docs[6])
    assert [x for _, ids, _ in long for x in ids] == ids_of("word " * 40_000, 0) and {n for *_, n in long} == {len(ids_of("word " * 40_000, 0))}


def test_level_array_prefers_the_least_sum_of_squares():
    packer = packing.Packer(16, 100)
    for i, n in enumerate([10, 10, 6, 6, 5]):
        packer.add(packing.Piece(i, 0, np.zeros(n, "<u2"), n))
    # both windows of 10 are filled up by the sixes
    assert len(packer.closed) == 2 and packer.levels.sum() == 1 and packer.levels[5] == 1


def test_pour_bounds_open_windows():
    packer = packing.Packer(16, 8)
    for i in range(100):
        packer.add(packing.Piece(i, 0, np.zeros(9, "<u2"), 9))
        assert packer.levels.sum() <= 8
    packer.finish()
    sizes = [sum(len(p.ids) for p in w) for w in packer.closed]
    assert sum(sizes) == 900 and all(s == 16 or s & (s - 1) == 0 for s in sizes)


def test_empty_tables(spark, nothing):
    assert packing.pack(nothing, PATH).count() == 0
    assert wavelet.read_shards(spark, wavelet.write_shards(nothing, PATH)).count() == 0


@pytest.mark.parametrize("shard_tokens", [1, 50, 1 << 22])
def test_shards_round_trip(spark, awkward, shard_tokens):
    rows = wavelet.read_shards(spark, wavelet.write_shards(awkward, PATH, shard_tokens=shard_tokens)).orderBy("start").collect()
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens
    got = sorted(((r.doc_id is not None, r.doc_id or 0), bytes(r.ids)) for r in rows)
    want = sorted(((r.doc_id is not None, r.doc_id or 0), np.array(ids_of(r.text, 2), "<u4").tobytes()) for r in awkward.collect())
    assert got == want
    assert [r.doc_id for r in rows] == sorted((r.doc_id for r in rows), key=lambda x: (x is not None, x or 0))
    assert all(zlib.crc32(r.ids) >= 0 for r in rows)


@pytest.mark.parametrize("n", [0, 1, 700, wavelet.BLOCK + 5])
def test_wavelet_lookups(n):
    ids = np.random.default_rng(n).integers(0, 9, n).astype("<u2")
    shard = wavelet.WaveletFile(wavelet.build([5, None], [ids, np.zeros(0, "<u2")]))
    assert shard.decode().tolist() == ids.tolist() and shard.doc_ids == [5, None] and shard.firsts.tolist() == [0, n, n]
    for place in {*range(min(n, 40)), *([n - 1] if n else [])}:
        assert shard.access(place) == ids[place]
    for token in (0, 3, 8, 9, 70_000):
        places = np.flatnonzero(ids == token)
        assert shard.count(token) == len(places) and shard.rank(token, n // 2) == (places < n // 2).sum()
        if len(places):
            assert shard.select(token, len(places) - 1) == places[-1]
    if n == 700:
        assert shard.occurrences(4) == np.flatnonzero(ids == 4).tolist()
    with pytest.raises(IndexError):
        shard.access(n)
