"""Coders over streams of blocks: their symbols are those of the whole text, whatever the cuts, triggers and restarts."""

import random

import pytest
from pyspark.sql import functions as F

from rasterloom.operators import lz
from rasterloom.plans import streams
from rasterloom.streaming import coders


def texts():
    r = random.Random(5)
    return [
        b"", b"a", b"ab", b"\7" * 3000, b"abcdef" * 2, b"abcabcabcabc" * 30, bytes(r.choice(b"ab") for _ in range(900)), r.randbytes(700),
        b"the quick brown fox jumps " * 20 + b"over" + b"the quick brown fox jumps " * 20, bytes(range(256)) * 3, bytes(300) + b"x" + bytes(300),
    ]


@pytest.fixture()
def small(monkeypatch):
    """A short window and short copies, so that bytes leave the ring and generations turn."""
    for module in (lz, coders):
        monkeypatch.setattr(module, "MOST", 40)
        monkeypatch.setattr(module, "WINDOW", 100)


@pytest.mark.parametrize("seed", range(6))
def test_coders_in_pieces(seed, small):
    r = random.Random(seed)
    for data in texts():
        pairs, copies, p, q, at = [], [], coders.PairCoder(), coders.CopyCoder(), 0
        while True:
            n = r.randint(0, 150)
            last = at + n >= len(data)
            pairs += p.code(data[at : at + n], last)
            copies += q.code(data[at : at + n], last)
            # from what the state store keeps
            p = coders.PairCoder(p.edges, p.numbers, p.number, p.opened, p.rest, p.odd)
            q = coders.CopyCoder(bytes(q.ring.data), q.ring.base, q.at, q.start)
            at += n
            if last:
                break
            assert len(q.ring.data) <= coders.WINDOW + 2 * coders.MOST + 150
        assert pairs == lz.dict_symbols(data) and copies == lz.back_symbols(data)


def test_every_match_is_the_oldest_longest(small):
    for data in texts():
        ring = coders.Ring(data)
        for at in range(len(data)):
            best = (0, 0)
            for p in range(max(0, at - coders.WINDOW), at):
                most, k = min(at - p, len(data) - at, coders.MOST), 0
                while k < most and data[p + k] == data[at + k]:
                    k += 1
                if k >= lz.MIN_REP and k > best[0]:
                    best = (k, at - p)
            assert ring.match(at) == best
        # an entry stays until the generation after its own is full
        held = [p for g in (ring.old, ring.young) for places in g.values() for p in places]
        assert len(held) <= 2 * coders.WINDOW + 1


@pytest.mark.parametrize("coder, waves", [("pairs", (2, 1)), ("copies", (2, 1)), ("pairs", ()), ("copies", (0, 3))])
def test_streams_over_triggers_and_restarts(spark, tmp_path, coder, waves):
    data = spark.createDataFrame([(i, t) for i, t in enumerate(texts())], "doc_id long, data binary")
    blocks = coders.in_blocks(data, 100)
    if coder == "pairs":
        got = streams.in_waves(blocks, coders.stream_pairs, waves, str(tmp_path)).collect()
        for i, t in enumerate(texts()):
            own = sorted((r for r in got if r.doc_id == i), key=lambda r: r.start)
            assert [s for r in own for s in r.symbols] == lz.dict_symbols(t)
    else:
        got = streams.in_waves(blocks, coders.stream_copies, waves, str(tmp_path)).collect()
        for i, t in enumerate(texts()):
            own = sorted((r for r in got if r.doc_id == i), key=lambda r: r.seq)
            assert [r.seq for r in own] == list(range(len(own)))
            assert [("back", r.size, r.back) if r.explicit is None else ("explicit", bytes(r.explicit)) for r in own] == lz.back_symbols(t)


def test_state_is_kept_and_cleared(spark, tmp_path):
    """Texts that have ended leave no state; of one that goes on the ring is there."""
    rows = [(1, 0, b"abcabcabc", False), (1, 1, b"abcabc", False), (2, 0, b"xyz", True), (3, 0, None, False)]
    blocks = spark.createDataFrame(rows, "doc_id long, block long, data binary, last boolean")
    streams.in_waves(blocks, coders.stream_copies, (1,), str(tmp_path))
    state = spark.read.format("statestore").option("stateVarName", "ring").load(f"{tmp_path}/state")
    assert sorted((r["key"]["key"], bytes(r["value"]["ring"])) for r in state.collect()) == [(1, b"abcabcabcabcabc"), (3, b"")]


def test_a_missing_block_raises(spark, tmp_path):
    rows = [(1, 0, b"abc", False), (1, 2, b"abc", True)]
    with pytest.raises(Exception, match="block 2 came where 1 was due"):
        streams.in_waves(spark.createDataFrame(rows, "doc_id long, block long, data binary, last boolean"), coders.stream_pairs, (), str(tmp_path))


def test_blocks(spark):
    data = spark.createDataFrame([(1, b""), (2, b"abcde"), (3, b"abcdef"), (4, None)], "doc_id long, data binary")
    got = {}
    for r in coders.in_blocks(data, 3).orderBy("doc_id", "block").collect():
        got.setdefault(r.doc_id, []).append((r.block, None if r.data is None else bytes(r.data), r.last))
    assert got[1] == [(0, b"", True)] and got[2] == [(0, b"abc", False), (1, b"de", True)] and got[3] == [(0, b"abc", False), (1, b"def", True)]
    assert [x[0] for x in got[4]] == [0]


def test_a_trigger_adds_one_entry_to_the_trie(spark, tmp_path):
    """What a trigger learns is one entry of the state, however many edges it has; entries are read in their order."""
    data = bytes(range(200)) * 5
    blocks = coders.in_blocks(spark.createDataFrame([(1, data)], "doc_id long, data binary"), 300).withColumn("last", F.lit(False))
    streams.in_waves(blocks, coders.stream_pair_bytes, (1, 2), str(tmp_path))
    state = spark.read.format("statestore").option("stateVarName", "trie").option("flattenCollectionTypes", True).load(f"{tmp_path}/state").collect()
    coder, whole = coders.PairCoder(), data
    for cut in (whole[:300], whole[300:900], whole[900:]):
        coder.code(cut, False)
    assert len(state) == 3
    assert sum(len(r["list_element"]["edges"]) for r in state) == 8 * len(coder.edges)


def test_a_texts_bytes_meet_its_symbols_once(spark):
    """They are dealt once and not once a symbol: the plan joins after symbols are gathered, and groups no texts."""
    text = b"abcdefgh" * 20
    data = spark.createDataFrame([(1, text), (2, b"x")], "doc_id long, data binary")
    rows = [(1, i, bytes([b])) for i, b in enumerate(text)] + [(2, 0, b"y")]
    seen = streams._compared(spark.createDataFrame(rows, "doc_id long, place long, wire binary").orderBy(F.rand(3)), data, bytes, bytes)
    assert sorted((r.doc_id, r.n_bytes, r.as_batch) for r in seen.collect()) == [(1, 160, True), (2, 1, False)]
    assert "FlatMapGroups" not in seen._jdf.queryExecution().executedPlan().toString()


def test_finding_equals_matching():
    """Without an index the copies are those that the index finds."""
    for data in texts():
        ring, indexed = coders.Ring(data), coders.Ring(data)
        assert all(ring.find(at) == indexed.match(at) for at in range(len(data)))
        assert not ring.old and not ring.young
