"""Huffman codes made over arrays against those of the tree."""

import numpy as np

from rasterloom.operators import huffman


def test_codes_by_arrays_are_those_of_the_tree():
    r = np.random.default_rng(4)
    for kind, low in ((huffman.RGB, 0), (huffman.SIGNED, -9)):
        for n in (1, 2, 3, 50, 700):
            rows = np.minimum(r.geometric(0.3, (n, 3)), 200) + low
            symbols = list(map(tuple, rows.tolist()))
            root = huffman.tree({s: symbols.count(s) for s in symbols})
            book = huffman.codes(root)
            data = huffman.encode_array(rows, kind)
            assert data == huffman.dump(root, kind[1]) + huffman.packed("".join(book[s] for s in symbols))
            assert (huffman.decode_array(b"12" + data, 2, n, kind) == rows).all()
