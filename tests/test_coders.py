import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rasterloom.operators import huffman, lz
from rasterloom.operators.sequence import MeanRuns

SCAN = [3, 3, 5, 7, 6, 6, 8, 8, 7, 7, 7, 8, 9, 9, 8, 9]


@pytest.mark.parametrize("data, want", [([], []), ([1], [1, 0xFFFF]), ([1, 2], [1, 2]), ([1, 2, 1, 3], [1, 2, 1, 3]), ([1, 2] * 3, [1, 2, 0x100, 0x100])])
def test_dict_symbols(data, want):
    assert lz.dict_symbols(bytes(data)) == want


@pytest.mark.parametrize("data", [b"", b"\1", b"\1\2", b"\1\1", b"\1" * 6])
def test_short_inputs_are_explicit(data):
    assert lz.back_symbols(data) == ([("explicit", data)] if data else [])


def test_back_symbols():
    assert lz.back_symbols(b"\1" * 16) == [("explicit", b"\1" * 8), ("back", 8, 8)]
    assert lz.back_symbols(b"\1" * 8 + b"\2" * 8) == [("explicit", b"\1" * 8 + b"\2" * 8)]


def test_long_copies_and_blocks_are_split():
    for data in (bytes(100_000), random.Random(1).randbytes(80_000)):
        symbols = lz.back_symbols(data)
        assert all((len(s[1]) if s[0] == "explicit" else s[1]) <= lz.MOST for s in symbols)
        assert lz.back_decode(lz.back_parse(lz.back_bytes(symbols))) == data


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([0, 1, 2, 200]), max_size=300))
def test_coders_give_back(data):
    data = bytes(data)
    assert lz.dict_decode(lz.dict_parse(lz.dict_bytes(lz.dict_symbols(data)))) == data
    assert lz.back_decode(lz.back_parse(lz.back_bytes(lz.back_symbols(data)))) == data


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from([0, 1, 2]), min_size=10, max_size=120), st.integers(0, 100))
def test_longest_match_is_the_oldest_longest(data, at):
    data, at = bytes(data), at % len(data)
    best = (0, 0)
    for p in range(at):
        k = 0
        while p + k < at and at + k < len(data) and data[p + k] == data[at + k]:
            k += 1
        if k >= lz.MIN_REP and k > best[0]:
            best = (k, at - p)
    assert lz.longest_match(data, at) == best


def test_dict_decode_refuses_odd_and_unknown():
    with pytest.raises(ValueError):
        lz.dict_decode([1])
    with pytest.raises(ValueError):
        lz.dict_decode([1, 0x200])


def test_huffman_lengths():
    assert {k: len(v) for k, v in huffman.codes(huffman.tree({"a": 2, "b": 1, "c": 1})).items()} == {"a": 1, "b": 2, "c": 2}


def test_bits_on_the_wire():
    codes = {"a": "010", "b": "11110000011", "c": "00"}
    assert huffman.packed("".join(codes[c] for c in "abc")) == b"\x5e\x0c"
    assert huffman.packed("0000110" + "11111111" + "0") == b"\x0d\xfe"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(*[st.integers(0, 3)] * 3), min_size=1, max_size=80))
def test_huffman_gives_back(symbols):
    data = huffman.encode_all(symbols, huffman.RGB)
    assert huffman.decode_all(data, 0, len(symbols), huffman.RGB) == symbols
    book = huffman.codes(huffman.tree({s: symbols.count(s) for s in symbols}))
    if len(book) > 1:
        assert sum(2.0 ** -len(c) for c in book.values()) == 1


def test_huffman_refuses():
    with pytest.raises(ValueError):
        huffman.tree({})
    with pytest.raises(ValueError):
        huffman.parse(b"\x07", 0, 11, huffman.RGB[2])


def test_mean_runs():
    got = MeanRuns(1, 1).runs((v,) for v in SCAN)
    assert [(n, v[0]) for n, v in got] == [(2, 3), (1, 5), (3, 6), (6, 8), (4, 9)]
    assert [n for n, _ in MeanRuns(0, 1).runs((7,) for _ in range(600))] == [255, 255, 90]
    for bad in (-1.0, float("nan"), float("inf")):
        with pytest.raises(ValueError):
            MeanRuns(bad)
