"""Copies that an index finds against those of the search."""

import random

import numpy as np
import pytest

from rasterloom.operators import lz
from rasterloom.plans import codecs


@pytest.mark.parametrize("window, stretch", [(65535, 1 << 17), (200, 500)])
def test_copies_by_an_index_are_those_of_the_search(monkeypatch, window, stretch):
    monkeypatch.setattr(lz, "WINDOW", window)
    monkeypatch.setattr(lz, "STRETCH", stretch)
    r = random.Random(6)
    noise = codecs.pixel_bytes(np.array([[r.choice((0, 50, 100)) for _ in range(3)] for _ in range(400)]))
    texts = [noise, b"x" * 3000, b"ab" * 700, r.randbytes(900), *(bytes(r.choices(b"ab", k=r.randint(0, 200))) for _ in range(150))]
    for data in texts:
        monkeypatch.setattr(lz, "UNAIDED", 0)
        by_index = lz.back_symbols(data)
        monkeypatch.setattr(lz, "UNAIDED", -1)
        assert lz.back_symbols(data) == by_index and lz.back_decode(by_index) == data
