from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rasterloom.llm import language_id, sentencepiece, token_counts, vocab
from rasterloom.llm.vocab import SPACE, load, split_spaces, vocab_of
from tests.llm.conftest import prose, texts

ALL = texts()


@pytest.fixture(scope="module")
def v():
    return vocab_of(load())


@pytest.fixture(scope="module")
def library():
    """The public library on the same pieces, with unigram scores; pieces without a rank get the one after the last."""
    import sentencepiece as lib
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.ParseFromString(load())
    m.trainer_spec.model_type = 1
    worst = min(p.score for p in m.pieces if p.type == 1 and p.score > -1e8)
    for p in m.pieces:
        if p.type == 1 and p.score < -1e8:
            p.score = worst - 1
    return lib.SentencePieceProcessor(model_proto=m.SerializeToString())


def test_encoding_is_the_librarys(v, library):
    own = [t for t in ALL if t is not None and len(t) < 2000] + ["  two  spaces ", "Größe 12", "日本語 x"]
    ids, ends = sentencepiece.Encoder(v).encode(own)
    for t, a, b in zip(own, ends[:-1], ends[1:], strict=True):
        if SPACE not in t:
            assert ids[a:b].tolist() == library.encode(t)


def plain_path(v, word):
    """The best segmentation of a word, place by place, without a cut."""
    best, back = [0.0], [None]
    for j in range(1, len(word) + 1):
        options = [(best[j - n] + v.scores[v.ids[word[j - n : j]]], n, v.ids[word[j - n : j]]) for n in range(1, min(j, v.longest) + 1) if word[j - n : j] in v.ids]
        if word[j - 1] not in v.ids:
            options.append((best[j - 1] + v.unk_score, 0, -1))
        top = max(options, key=lambda o: o[:2])
        best.append(top[0])
        back.append((max(top[1], 1), top[2]))
    out, j = [], len(word)
    while j:
        n, i = back[j]
        out.extend([i] if i >= 0 else v.bytes[list(word[j - 1].encode())].tolist()[::-1])
        j -= n
    return out[::-1]


def plain_sum(v, p, word):
    """Log of the summed probabilities of all segmentations of a word, place by place, without a cut."""
    a, scale = [np.ones(p.shape[1])], np.zeros(p.shape[1])
    for j in range(1, len(word) + 1):
        x = np.zeros(p.shape[1])
        for n in range(1, min(j, v.longest) + 1):
            i = v.ids.get(word[j - n : j])
            x += a[-n] * (p[i] if i is not None else 1e-7 if n == 1 else 0.0)
        a = [*a[-v.longest :], x]
        a, scale = [y / x for y in a], scale + np.log(x)
    return scale


def long_words():
    r = np.random.default_rng(5)
    cjk = "".join(map(chr, r.integers(0x4E00, 0x9FA5, 1 << 16)))
    mixed = "".join(["Straße", "река", "日本語", "x" * 9, "naïve", "😀", "1234"][k] for k in r.integers(0, 7, 3000))
    return {"cjk": SPACE + cjk, "letters": SPACE + "x" * 10_000, "mixed": SPACE + mixed, "latin": SPACE + "".join(prose(7, 2000).split())}


@pytest.mark.parametrize("name", list(long_words()))
def test_long_words_are_those_of_plain_code(v, name):
    word = long_words()[name]
    assert "".join(v.segments(word)) == word
    want = plain_path(v, word)
    assert sentencepiece.Encoder(v).encode([word[1:]])[0].tolist() == want
    assert token_counts.Trie(v).counts([word]).tolist() == [len(want)]
    p = np.random.default_rng(2).random((len(v.pieces), 2)) * 1e-3
    assert np.allclose(language_id.Scorer(v, p).texts([word[1:].lower()])[0], plain_sum(v, p, word.lower()))


def test_a_megabyte_without_spaces(v):
    text = "".join(map(chr, np.random.default_rng(6).integers(0x4E00, 0x9FA5, 350_000)))
    e = sentencepiece.Encoder(v)
    ids = e.encode([text])[0].tolist()
    assert sentencepiece.decode_ids(v, ids) == text
    e.encode(["x" * (9 << 20)])
    assert e.words.begin()  # words are not kept beyond a number of characters


@pytest.mark.parametrize("stretch", [16, 100, 333])
def test_long_words_by_stretches(v, monkeypatch, stretch):
    """What crosses from one stretch of a word into the next is carried along."""
    cut = {name: (v.segments(w[:1500]), w[:1500]) for name, w in long_words().items()}
    monkeypatch.setattr(vocab, "STRETCH", stretch)
    monkeypatch.setattr(sentencepiece, "STRETCH", stretch)
    monkeypatch.setattr(token_counts, "DEEP", 50)
    for segments, word in cut.values():
        want = plain_path(v, word)
        assert v.segments(word) == segments
        assert list(sentencepiece.long_path(v, word)) == want and token_counts.Trie(v).tokens(word) == len(want)
        assert SPACE + sentencepiece.decode_ids(v, np.array(want)) == word


@pytest.mark.parametrize("name", list(long_words()))
def test_sums_by_windows(v, name):
    word = long_words()[name][:3007].lower()
    p = np.random.default_rng(4).random((len(v.pieces), 3)) * 1e-3
    gains = language_id._gains(p)
    assert np.allclose(language_id.long_sum(v, gains, word), plain_sum(v, p, word), rtol=1e-12)
    assert np.allclose(language_id.long_sum(v, gains, word[:40]), language_id.log_sums(v, gains, [word[:40]], 40)[0], rtol=1e-12)


def test_one_letter_a_million_times_takes_little_memory():
    """In a process of its own: its peak, the library and the vocabulary included."""
    import subprocess
    import sys

    code = (
        "import resource, numpy as np\n"
        "from rasterloom.llm import language_id, sentencepiece, token_counts\n"
        "from rasterloom.llm.vocab import SPACE, load, vocab_of\n"
        "v, text = vocab_of(load()), 'x' * 1_000_000\n"
        "ids = sentencepiece.Encoder(v).encode([text])[0]\n"
        "assert sentencepiece.decode_ids(v, ids) == text\n"
        "assert token_counts.Trie(v).counts([SPACE + text]).tolist() == [len(ids)]\n"
        "language_id.Scorer(v, np.full((len(v.pieces), 4), 1e-4)).texts([text])\n"
        "print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)"
    )
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=Path(__file__).parents[2])
    assert int(out.stdout.split()[-1]) < 400


def test_one_letter_a_million_times_by_the_own_peak():
    """As above, by VmHWM: ru_maxrss is carried over exec, so there it is at least the peak of whatever ran the test."""
    import subprocess
    import sys

    code = (
        "import re, numpy as np\n"
        "from rasterloom.llm import language_id, sentencepiece, token_counts\n"
        "from rasterloom.llm.vocab import SPACE, load, vocab_of\n"
        "v, text = vocab_of(load()), 'x' * 1_000_000\n"
        "ids = sentencepiece.Encoder(v).encode([text])[0]\n"
        "assert token_counts.Trie(v).counts([SPACE + text]).tolist() == [len(ids)]\n"
        "language_id.Scorer(v, np.full((len(v.pieces), 4), 1e-4)).texts([text])\n"
        "print(int(re.search(r'VmHWM:\\s+(\\d+)', open('/proc/self/status').read())[1]) // 1024)"
    )
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=Path(__file__).parents[2])
    assert int(out.stdout.split()[-1]) < 400


def test_fitting_counts_long_words(v):
    """A word without a cut counts in fitting, however long it is."""
    from collections import Counter

    langs, p = language_id.fit(v, {"aa": Counter({"x" * 2000: 1}), "bb": Counter({"garden": 300})})
    of_x = [i for piece, i in v.ids.items() if set(piece) == {"x"}]
    assert p[of_x, 0].sum() > 10 * p[of_x, 1].sum()


def test_trie_shares_prefixes_across_batches(v):
    t = token_counts.Trie(v)
    first = t.counts([SPACE + "river", SPACE + "rivers"])
    made = len(t.best)
    assert made == 1 + len(SPACE + "rivers")
    assert t.counts([SPACE + "riverside"]).tolist() == [len(plain_path(v, SPACE + "riverside"))]
    assert len(t.best) == made + 3 and first.tolist() == [len(plain_path(v, SPACE + w)) for w in ("river", "rivers")]


@settings(max_examples=80, deadline=None)
@given(st.text(max_size=40))
def test_round_trip_and_counts(text):
    v = vocab_of(load())
    ids = sentencepiece.Encoder(v).encode([text])[0].tolist()
    assert sentencepiece.decode_ids(v, ids) == text.replace(SPACE, " ")
    words = [SPACE + w.replace(" ", SPACE) for w in split_spaces(text)] if text else []
    assert token_counts.Trie(v).counts(words).sum() == len(ids)
    assert [i for w in words for i in sentencepiece.long_path(v, w)] == ids
    assert [i for w in words for i in plain_path(v, w)] == ids


def test_encode_rows(docs, empty):
    rows = sentencepiece.encode(docs).collect()
    assert len(rows) == len(ALL) + 1
    for r in rows:
        t = ALL[r.doc_id]
        assert (r.ids is None) == (t is None) and r.n_tokens == len(r.ids or [])
        assert r.round_trip == (None if t is None else SPACE not in t)
    back = {r.doc_id: r.decoded for r in sentencepiece.decode(sentencepiece.encode(docs)).collect()}
    assert back[0] is None and back[6] == ALL[6]
    assert sentencepiece.encode(empty).collect() == []


def test_counts_are_lengths(docs, empty):
    lengths = {r.doc_id: r.n_tokens for r in sentencepiece.encode(docs).collect()}
    rows = token_counts.token_counts(docs).collect()
    assert len(rows) == len(ALL) + 1 and all(r.n_tokens == lengths[r.doc_id] for r in rows)
    assert token_counts.token_counts(empty).collect() == []


def test_forward_sums_all_segmentations(v):
    p = np.random.default_rng(2).random((len(v.pieces), 2)) * 1e-3
    word = "rivers"
    spaced = SPACE + word

    def total(j, k):
        if j == 0:
            return 1.0
        out = sum(total(j - n, k) * p[v.ids[spaced[j - n : j]], k] for n in range(1, j + 1) if spaced[j - n : j] in v.ids)
        return out

    s = language_id.Scorer(v, p)
    got = s.texts([word])[0]
    assert np.allclose(got, [np.log(total(len(spaced), k)) for k in (0, 1)])


def test_language_rows(spark, docs, empty):
    german = ["der stein und das licht im winter", "die ruhige nacht und der garten", "das haus steht nicht auf dem berg"]
    rows = [(i, prose(i, 30), "en") for i in range(40)] + [(100 + i, " ".join(german[(i + k) % 3] for k in range(3)), "de") for i in range(40)]
    langs, p = language_id.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert langs == ["de", "en"]
    got = {r.doc_id: r for r in language_id.identify(docs, langs, p).collect()}
    assert got[6].lang_pred == "en" and got[6].score > 0.9
    for i, t in enumerate(ALL):
        letters = any(c.isalpha() for c in t or "")
        assert (got[i].lang_pred != "und") == letters and 0 <= got[i].score <= 1
    assert language_id.op1(empty).collect() == []


def test_language_of_ties_repeats_and_no_id(spark, v):
    """Equal languages tie to the first in order; repeated rows and rows without an id have a row each."""
    p = np.full((len(v.pieces), 2), 1.0 / len(v.pieces))
    rows = [(None, "the stone"), (4, "the stone"), (4, "the stone"), (5, None)]
    got = language_id.identify(spark.createDataFrame(rows, "doc_id long, text string"), ["aa", "bb"], p).collect()
    assert sorted((r.doc_id or 0, r.lang_pred, r.score) for r in got) == [(0, "aa", 0.5), (4, "aa", 0.5), (4, "aa", 0.5), (5, "und", 0.0)]


def test_fit_follows_the_counts(v):
    """Expectation maximisation over one word whose segmentations are two: the likelihood never falls."""
    from collections import Counter

    words = {"en": Counter({"rivers": 5, "river": 3, "garden": 2}), "de": Counter({"garten": 4, "fluss": 4})}
    before = -np.inf
    for rounds in (1, 2, 4, 8):
        language_id.ROUNDS, kept = rounds, language_id.ROUNDS
        try:
            langs, p = language_id.fit(v, words)
        finally:
            language_id.ROUNDS = kept
        s = language_id.Scorer(v, p)
        now = sum(n * s.texts([w])[0][langs.index(g)] for g, c in words.items() for w, n in c.items())
        assert np.allclose(p.sum(0), 1) and now >= before - 1e-6
        before = now


def test_nothing_to_learn_from(docs):
    assert {r.lang_pred for r in language_id.op1(docs.filter("lang IS NULL")).collect()} == {"und"}
