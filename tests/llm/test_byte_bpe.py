import base64
import hashlib
import random
import struct

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from rasterloom.llm import byte_bpe
from tests.llm.conftest import prose, texts

ALL = texts()


@pytest.fixture(scope="module")
def m():
    return byte_bpe.encoder_of(byte_bpe.load()).merges


@pytest.fixture(scope="module")
def library(m):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=m.rank, special_tokens={})


def test_every_token_is_made_by_merges(m):
    assert len(m.right) == len(m.rank)


def test_query_is_the_librarys(spark, docs, library):
    got = byte_bpe.op12(docs).collect()
    assert len(got) == len(ALL) + 1
    for r in got:
        ids = library.encode_ordinary(ALL[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((ALL[r.doc_id] or "").encode()).hexdigest()


def test_empty_table(empty):
    assert byte_bpe.op12(empty).collect() == []


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(), st.text("ab's  \n\té=-19"), st.sampled_from([" " * 70, "=" * 90, "the theatre's", "日本語"])), max_size=6).map("".join))
def test_any_text(m, library, text):
    ids, _ = byte_bpe.encoder_of(byte_bpe.load()).encode([text])
    assert ids.tolist() == library.encode_ordinary(text)
    assert m.decode(ids)[0].tobytes().decode() == text


def test_every_prefix_has_the_librarys_last_token(m, library):
    word = b"internationalisierungsmissverstaendnisse"
    p = byte_bpe.Prefixes(m, word)
    for j in range(1, len(word) + 1):
        assert p.last[j - 1] == library.encode_ordinary(word[:j].decode())[-1]


def test_one_long_word_and_one_long_text(m, library):
    r = random.Random(3)
    for text in ("x" * 300_000, "".join(r.choice("abcdefghij") for _ in range(50_000)), " " * 9000 + "x", prose(5, 20_000)):
        ids, _ = byte_bpe.encoder_of(byte_bpe.load()).encode([text])
        assert ids.tolist() == library.encode_ordinary(text)


@settings(max_examples=150, deadline=None)
@given(st.text("abcthe", max_size=400), st.integers(0, 400), st.integers(0, 5), st.text("abcthe", max_size=5), st.text("xyz", max_size=4))
def test_appends_and_edits_of_a_word(m, word, at, removed, inserted, tail):
    word = word.encode()
    at, inserted = min(at, len(word)), inserted.encode()
    p = byte_bpe.Prefixes(m, word)
    looked = p.replace(at, removed, inserted)
    p.append(tail.encode())
    q = byte_bpe.Prefixes(m, word[:at] + inserted + word[at + removed :] + tail.encode())
    assert (p.data, p.last, p.nodes) == (q.data, q.last, q.nodes)
    assert looked <= len(word) + len(inserted)


def test_an_edit_looks_at_few_prefixes(m):
    r = random.Random(4)
    p = byte_bpe.Prefixes(m, "".join(r.choice("etaoinshr") for _ in range(20_000)).encode())
    assert p.replace(500, 2, b"th") < 1000


@settings(max_examples=150, deadline=None)
@given(st.text("ab's \n19.é", max_size=60), st.integers(0, 60), st.integers(0, 4), st.text("ab's \n19.é", max_size=4))
def test_edits_of_a_text(library, text, at, removed, inserted):
    at = min(at, len(text))
    removed = min(removed, len(text) - at)
    e = byte_bpe.encoder_of(byte_bpe.load())
    new, ids, _ = e.edited(text, np.array(library.encode_ordinary(text), np.int32), at, removed, inserted)
    assert new == text[:at] + inserted + text[at + removed :] and ids.tolist() == library.encode_ordinary(new)


def test_edits_of_a_table(spark, docs, library):
    encoded = byte_bpe.encode(docs).dropDuplicates(["doc_id"]).join(docs.select("doc_id", "text").dropDuplicates(["doc_id"]), "doc_id")
    edits = encoded.selectExpr("doc_id", "text", "ids", "length(text) div 2 AS at", "0 AS removed", "'new words' AS inserted")
    for r in byte_bpe.apply_edits(edits).collect():
        t = ALL[r.doc_id] or ""
        want = t[: len(t) // 2] + "new words" + t[len(t) // 2 :]
        assert (r.text, r.ids) == (want, library.encode_ordinary(want))
    assert byte_bpe.apply_edits(edits.limit(0)).collect() == []
    with pytest.raises(Exception, match="no 5 characters at 90"):
        byte_bpe.apply_edits(spark.createDataFrame([(1, "a", [64], 90, 5, None)], "doc_id long, text string, ids array<int>, at int, removed int, inserted string")).collect()


def test_decoding_a_table(spark, docs):
    for r in byte_bpe.decode(byte_bpe.encode(docs)).collect():
        assert r.decoded.decode() == (ALL[r.doc_id] or "")


def test_a_token_that_no_merge_makes():
    """Its bytes are one match, so it stands alone; elsewhere merges never reach it."""
    contents = byte_ranks({b"ab": 256, b"cd": 257, b"abcd": 300, b"bc": 200_000, b"xyz": 400})
    m = byte_bpe.Merges(contents)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=m.rank, special_tokens={})
    assert set(m.rank.values()) - set(m.right) == {400}
    e = byte_bpe.Encoder(m)
    r = random.Random(1)
    for t in ["xyz", "axyz", "abcd", "bcd", "abc"] + ["".join(r.choice("abcdxyz ") for _ in range(12)) for _ in range(300)]:
        assert e.encode([t])[0].tolist() == library.encode_ordinary(t)


def byte_ranks(more):
    ranks = {bytes([b]): b for b in range(256)} | more
    return b"\n".join(base64.b64encode(t) + b" " + str(r).encode() for t, r in ranks.items())


def test_a_file_without_all_bytes():
    with pytest.raises(ValueError, match="every byte"):
        byte_bpe.Merges(b"YQ== 0\n")
