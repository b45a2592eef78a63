import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.llm import media, mixing, quality_crf, toxicity
from tests.llm.conftest import prose, texts

ALL = texts()


def brute_marginals(e, trans):
    n = len(e)
    total, good = 0.0, np.zeros(n)
    for m in range(1 << n):
        y = [(m >> i) & 1 for i in range(n)]
        p = np.exp(sum(e[i] for i in range(n) if y[i]) + sum(trans[y[i], y[i + 1]] for i in range(n - 1)))
        total += p
        good += p * np.array(y)
    return good / total


def test_marginals_are_exact():
    r = np.random.default_rng(0)
    sizes = [1, 5, 3, 7]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    e, trans = r.normal(size=ends[-1]), r.normal(size=(2, 2))
    got, pairs = quality_crf.marginals(e, ends, trans)
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        assert np.allclose(got[a:b], brute_marginals(e[a:b], trans))
    assert np.isclose(pairs.sum(), sum(n - 1 for n in sizes))


def junk(seed):
    r = random.Random(seed)
    return "\n".join(" | ".join(r.choice(["BUY!!", "now###", "77%%"]) for _ in range(9)) for _ in range(6))


@pytest.fixture(scope="module")
def labelled(spark):
    rows, labels = [], []
    for i in range(240):
        bad, toxic = i % 4 == 0, i % 3 == 0
        words = prose(i, 80).split()
        if toxic:
            for w in ("dolthead", "wretchling", "dolthead"):
                words.insert(random.Random(i).randrange(len(words)), w)
        rows.append((i, junk(i) if bad else " ".join(words)))
        labels.append((i, int(not bad), int(toxic and not bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_held_out(labelled):
    docs, labels = labelled
    rows = quality_crf.op5(docs, labels).join(labels, "doc_id").collect()
    out = [r for r in rows if r.held_out]
    assert len(rows) == 240 and 20 < len(out) < 90
    assert np.mean([r.predicted == r.quality for r in out]) > 0.95


def test_quality_edges(labelled, docs, empty):
    model = quality_crf.learn(*labelled)
    rows = quality_crf.score(docs, model).collect()
    assert len(rows) == len(ALL) + 1 and all(0 <= r.score <= 1 for r in rows)
    assert quality_crf.score(empty, model).collect() == []
    kept = quality_crf.filter_good(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if r.score >= quality_crf.THRESHOLD}
    assert quality_crf.fit([], np.zeros(0, int), 0.0).scores([None]) > 0.99


def test_toxicity_held_out(labelled):
    docs, labels = labelled
    rows = toxicity.op7(docs, labels).join(labels, "doc_id").collect()
    assert np.mean([r.predicted == r.toxic for r in rows if r.held_out]) > 0.95


def test_toxicity_edges(labelled, docs, empty):
    model = toxicity.learn(*labelled)
    assert "dolthead" in model.terms or any(t and "dolthead".startswith(w) for w, t in model.terms.items())
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == len(ALL) + 1 and all(0 <= r.score < 0.5 for r in rows)
    assert toxicity.score(empty, model).collect() == []
    s = toxicity.Scorer(model)
    plain, quoted, clean = s.scores(["you dolthead and wretchling, dolthead", 'they said "dolthead" and called it a "wretchling" said one', "the quiet river"])
    assert plain > quoted and plain > clean
    assert toxicity.fit([], np.zeros(0, int), 0.0).weights[-1] < 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_is_edit_distance():
    terms = {"moron": False, "clown": False, "wretched": False, "lowland": True, "abc": False}
    a, r = toxicity.Automaton(terms), random.Random(1)
    for _ in range(3000):
        w = list(r.choice(list(terms)))
        for _ in range(r.randrange(3)):
            k = r.randrange(len(w) + 1)
            w[k : k + r.randrange(2)] = r.choice(["", "x", "o", "l"])
        w = "".join(w)
        found = [d for t, stem in terms.items() for cut in ([w] if not stem else [w[:k] for k in range(len(w) + 1)]) if (d := distance(cut, t)) <= toxicity.edits_for(len(t), stem)]
        assert a.edits(w) == min(found, default=-1), w


def test_media_round_trip(docs, empty):
    files = {r.doc_id: r.media for r in media.store(docs).collect()}
    for r in media.op6(docs).collect():
        data = (ALL[r.doc_id] or "").encode()
        payload = data + b" " * (max(192, -(-len(data) // 192) * 192) - len(data))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(data), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-16:]) and files[r.doc_id].endswith(payload)
        assert (r.media_bytes, r.media_sha256) == (len(files[r.doc_id]), hashlib.sha256(files[r.doc_id]).hexdigest())
        frames = range(0, len(payload) // 192, media.GROUP)
        assert r.codec == "raw" and r.duration_s == len(payload) / 192 / media.RATE
        head = len(files[r.doc_id]) - len(payload)
        assert [(k.offset, k.size, k.time_s) for k in r.keyframes] == [(head + 192 * i, 192, i / media.RATE) for i in frames]
    assert media.op6(empty).collect() == []
    stored = media.media_columns(media.store(docs)).collect()
    for r in stored:
        data = media.padded((ALL[r.doc_id] or "").encode())
        assert r.codec == "raw" and r.problem is None and r.duration_s == len(data) / 192 / media.RATE
        assert all(r.media[k.offset : k.offset + k.size] == data[i * media.GROUP * 192 :][:192] for i, k in enumerate(r.keyframes))


def test_media_damaged(spark):
    good = media.mux(media.padded(b"x" * 1000))
    rows = spark.createDataFrame([(0, None), (1, b""), (2, good[:300]), (3, good)], "i int, media binary")
    assert [r.problem is None for r in media.media_columns(rows).orderBy("i").collect()] == [False, False, False, True]


def test_media_video_after_audio_and_fragments():
    """The video track is shown, wherever it stands; a fragment without parts adds nothing."""
    good = media.mux(media.padded(b"x" * 1000))
    kinds = {p[-1]: (a, b) for p, a, b in media.boxes(memoryview(good))}
    a, b = kinds[b"moov"]
    ta, tb = kinds[b"trak"]
    video = good[ta - 8 : tb]
    sound = video.replace(b"vide", b"soun")
    tracks = media.index(good[: a - 8] + media.box(b"moov", good[a : ta - 8], sound, video) + good[b:])
    assert [t.handler for t in tracks] == ["soun", "vide"] and media.shown(tracks).handler == "vide"
    assert media.described(good)[3] is None and media.described(good + media.box(b"moof")) == media.described(good)
    packed = media.box(b"stz2", bytes(7) + bytes([4]) + (3).to_bytes(4, "big") + bytes([0x12, 0x30]))
    assert media._sizes(memoryview(packed), {b"stz2": (8, len(packed))}).tolist() == [1, 2, 3]


def test_media_fragments():
    """Samples of two fragments: sizes, times and marks given by sample, by fragment, by file, and from the data's place."""
    u4 = lambda *v: struct.pack(f">{len(v)}I", *v)
    whole = media.mux(media.padded(b"x" * 400))
    kinds = {p[-1]: (a, b) for p, a, b in media.boxes(memoryview(whole))}
    a, b = kinds[b"moov"]
    ta, tb = kinds[b"trak"]
    trex = media.full(b"trex", u4(1, 1, 5, 7, 0x10000))
    head = whole[: a - 8] + media.box(b"moov", whole[a:b], media.box(b"mvex", trex))
    shift = len(head) - b  # the tables still point at the frames where they stood
    file = bytearray(head + whole[b:])
    at = file.index(b"stco") + 12
    struct.pack_into(">I", file, at, struct.unpack_from(">I", file, at)[0] + shift)
    sizes, frames = [3, 1, 4], b"aaabcccc"

    def fragment(flags, fields, trun_flags, runs, payload):
        def made(lead):
            trun = media.full(b"trun", u4(len(runs)), struct.pack(">i", lead), *runs, flags=trun_flags | 1)
            tfdt = media.full(b"tfdt", struct.pack(">Q", 100), version=1) if flags & 0x20000 else b""
            return media.box(b"moof", media.full(b"mfhd", u4(1)), media.box(b"traf", media.full(b"tfhd", u4(1), fields, flags=flags), tfdt, trun))

        moof = made(len(made(0)) + 8)
        return moof + media.box(b"mdat", payload)

    n = len(file)
    one = fragment(0x20000, b"", 0x200, [u4(s) for s in sizes], frames)
    two = fragment(0x20008 | 0x20, u4(9, 0), 0x200, [u4(2), u4(2)], b"ddee")
    data = bytes(file) + one + two
    t = media.index(data)[0]
    assert len(t.sizes) == 3 + 3 + 2 and t.sizes[3:].tolist() == [3, 1, 4, 2, 2]
    assert media.read_samples(data, t) == media.padded(b"x" * 400) + frames + b"ddee"
    assert t.times.tolist() == [0, 1, 2, 100, 105, 110, 100, 109] and t.keys.tolist() == [0, 6, 7] and t.duration == 118
    first = n + len(one) - len(frames)
    assert t.offsets[3:].tolist() == [first, first + 3, first + 4, len(data) - 4, len(data) - 2]
    # with the first sample marked, a size for all of the file, and the data at the place that the fragment's head names
    last = media.box(b"mdat", b"0123456" * 2)
    tfhd = media.full(b"tfhd", u4(1), struct.pack(">Q", len(data) + 8), flags=0x1)
    trun = media.full(b"trun", u4(2), u4(0), flags=0x4)
    more = data + last + media.box(b"moof", media.box(b"traf", tfhd, trun))
    t = media.index(more)[0]
    assert t.sizes[-2:].tolist() == [7, 7] and t.keys.tolist() == [0, 6, 7, 8] and media.read_samples(more, t).endswith(b"0123456" * 2)
    assert media.described(data + media.box(b"moof", media.box(b"traf", media.full(b"tfhd", u4(9)))))[3] == "KeyError: 9"


def test_media_feature_and_clashing_columns(spark):
    data = media.mux(media.padded(b"y" * (192 * 30)))
    keys = ",".join(f"{len(data) - 192 * (30 - i)}+192" for i in (0, 12, 24))
    start = len(data) - 192 * 30
    want = f"vide raw 8x8 1.20s 30 samples 3 keys {start}+192..{start + 192 * 24}+192 {hashlib.sha256(keys.encode()).hexdigest()[:16]}"
    assert media.feature(media.index(data)[0]) == want
    rows = spark.createDataFrame([(1, "old", 5, "old", data, 3)], "_media0 int, codec string, _m int, problem string, media binary, Codecs int")
    (r,) = media.media_columns(rows).collect()
    assert (r._media0, r._m, r.Codecs, r.codec, r.duration_s, r.problem) == (1, 5, 3, "raw", 1.2, None)
    assert [f for f in r.asDict()].count("codec") == 1


def test_media_big_tables():
    data = bytes(range(256)) * 3 * 50
    f = media.mux(data)
    t = media.index(f)[0]
    assert media.read_samples(f, t) == data and len(t.sizes) == 200 and t.keys.tolist() == list(range(0, 200, 12))


def test_raking_meets_targets(spark):
    r = random.Random(5)
    cells = spark.createDataFrame([(s, g, t, r.randrange(50, 500)) for s in "abc" for g in ("en", "de") for t in range(3)], "source string, lang string, topic int, tokens long")
    want = {"source": {"a": 0.5, "b": 0.3, "c": 0.2}, "lang": {"en": 0.6, "de": 0.4}, "topic": {0: 0.2, 1: 0.3, 2: 0.5}}
    targets = {d: spark.createDataFrame(list(x.items()), f"value {'int' if d == 'topic' else 'string'}, share double") for d, x in want.items()}
    raked, error = mixing.rake(cells, targets)
    rows = raked.collect()
    assert error <= mixing.TOLERANCE
    for d, x in want.items():
        for value, share in x.items():
            assert abs(sum(c.raked for c in rows if c[d] == value) - share) < 1e-8
    grid = {(c.source, c.lang, c.topic): float(c.tokens) for c in rows}
    for _ in range(200):  # the same by plain loops
        for k, x in enumerate(want.values()):
            for value, share in x.items():
                total = sum(v for c, v in grid.items() if c[k] == value)
                grid |= {c: v * share / total for c, v in grid.items() if c[k] == value}
    assert all(abs(grid[c.source, c.lang, c.topic] - c.raked) < 1e-8 for c in rows)
    many, left = mixing._rake_many(cells, mixing._aimed(cells, targets), 1e-5)
    assert left <= 1e-5 and all(abs(grid[c.source, c.lang, c.topic] - c.raked) < 1e-4 for c in many.collect())
    assert all(abs(r.target - r.reached) < 1e-8 for r in mixing.report(raked, targets).collect())


def test_targets_that_contradict_each_other(spark):
    """Two cells on a diagonal cannot have half of each source and a tenth of one language: the error says how far off."""
    cells = spark.createDataFrame([("a", "en", 0, 10), ("b", "de", 0, 30)], "source string, lang string, topic int, tokens long")
    want = {"source": [("a", 0.5), ("b", 0.5), ("gone", 9.0)], "lang": [("en", 0.1), ("de", 0.9)], "topic": [(0, 1.0)]}
    targets = {d: spark.createDataFrame(x, f"value {'int' if d == 'topic' else 'string'}, share double") for d, x in want.items()}
    rows, error = mixing.rake(cells, targets)
    assert rows.count() == 2 and error > 0.1
    docs = spark.createDataFrame([(0, "x y", "a", "en"), (1, "z", "b", "de")], "doc_id long, text string, source string, lang string")
    alone = {**targets, "topic": spark.createDataFrame([(k, 1.0) for k in range(mixing.TOPICS)], "value int, share double")}
    with pytest.warns(UserWarning, match="targets are missed"):
        assert all(r.target_error > 0.1 for r in mixing.mix(docs, alone).collect())


def test_probabilities_and_draw_by_plain_code(spark):
    cells = spark.createDataFrame([("a", "en", 0, 100, 0.6), ("b", "en", 0, 100, 0.3), ("c", None, 0, 800, 0.1)], "source string, lang string, topic int, tokens long, raked double")
    got = {r.source: r.prob for r in mixing.probabilities(cells, 0.2).collect()}
    # 200 tokens: a whole (100), of the other 100 three quarters to b and one to c
    assert got["a"] == 1 and abs(got["b"] - 0.75) < 1e-9 and abs(got["c"] - 25 / 800) < 1e-9
    ids = spark.createDataFrame([(i,) for i in [*range(2000), 7, None]], "doc_id long").select("doc_id", mixing.draw().alias("u")).collect()
    u = [r.u for r in ids]
    assert ids[7].u == ids[2000].u and all(0 <= x < 1 for x in u) and abs(sum(u[:2000]) / 2000 - 0.5) < 0.03


def test_topics_part_texts_by_their_words(spark):
    r = random.Random(8)
    words = [[f"{k}word{i}" for i in range(40)] for k in "xyz"]
    texts = [" ".join(r.choice(words[i % 3]) for _ in range(60)) for i in range(90)]
    model = mixing.fit_topics(texts, 3)
    rows = [(i, t, "s", "en") for i, t in enumerate(texts)] + [(90, None, None, None), (91, " \n", "s", None), (0, texts[0], "s", "en")]
    got = mixing.described(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"), model=model).collect()
    topic = {r.doc_id: r.topic for r in got}
    assert [len({topic[i] for i in range(k, 90, 3)}) for k in range(3)] == [1, 1, 1] and len({topic[k] for k in range(3)}) == 3
    assert topic[90] == topic[91] == -1 and [r.tokens for r in got if r.doc_id in (90, 91)] == [1, 1]
    flat = mixing.fit_topics([])
    assert flat.shape == (mixing.PLACES + 1, 1)


def test_topics_are_learned_from_every_text(spark):
    """Each text weighs in the model, as in the fit of all at once: none of 2,500 is left out."""
    r = random.Random(9)
    words = [[f"{k}word{i}" for i in range(30)] for k in "xyz"]
    texts = [" ".join(r.choice(words[i % 3]) for _ in range(20)) for i in range(2500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = mixing.learn_topics(docs, topics=3)
    whole = mixing.fit_topics(texts, 3)
    assert model.shape == whole.shape == (mixing.PLACES + 1, 3)
    near = [min(np.abs(np.exp(model[:, k]) - np.exp(whole[:, j])).max() for j in range(3)) for k in range(3)]
    assert max(near) < 1e-3
    odd = docs.withColumn("text", F.when(F.col("doc_id") == 77, "solitary " * 400).otherwise(F.col("text")))
    at = mixing.places_of("solitary")
    assert max(mixing.learn_topics(odd, topics=3)[at]) > max(model[at]) + 1


def test_words_as_arrays_are_those_of_plain_code():
    """Split, put in lower case and hashed as arrays: every white space, capitals that become two letters or end a word, words of
    any length."""
    white = "".join(chr(c) for c in range(0x110000) if chr(c).isspace())
    lines = [*ALL, white, *(f"a{c}B" for c in white), "ΟΔΟΣ ΣΑΣ. İstanbul ẞ ǅ ﻿A", *(" ".join("Aé" * n + "x" * k for k in range(5)) for n in range(8))]
    text, place, size = mixing.words_of(lines)
    words = [(i, w) for i, line in enumerate(lines) for w in (line or "").split()]
    assert text.tolist() == [i for i, _ in words] and place.tolist() == [mixing.places_of(w) for _, w in words]
    assert size.tolist() == [len((line or "").split()) for line in lines]


def test_counts_of_any_size_are_kept(spark):
    """Counts that an entry has no room for stand apart and come back in their order."""
    lines = ["a " * n + "b " * m + f"c{n}" for n in (1, 31, 32, 70_000) for m in (0, 33)]
    rows = mixing.counted(spark.createDataFrame([(i, t, "s", "en") for i, t in enumerate(lines)], "doc_id long, text string, source string, lang string"))
    batches = rows.coalesce(1).orderBy("doc_id").toArrow().combine_chunks().to_batches()
    x = np.vstack([part.copy() for _, part in mixing._roots(batches)])
    for line, root in zip(lines, x, strict=True):
        want = np.zeros(mixing.PLACES)
        for w in line.split():
            want[mixing.places_of(w)] += 1
        assert np.array_equal(np.rint(root.astype(float) ** 2), want)


def test_topics_begin_from_texts_drawn_from_all(spark, monkeypatch):
    """Draws look at few texts, and find what draws over all rows find; where the few do not settle one, all are looked at."""
    r = random.Random(10)
    texts = [" ".join(f"{'xyz'[i % 3]}{r.randrange(40)}" for _ in range(20)) for i in range(3000)] + ["copy of a text"] * 500
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    drawn, looked, begun = mixing._drawn, [], []

    def seen(rows, rarity, have, turn):
        looked.append(rows.count())
        begun.append({fit: x.copy() for fit, x in have.items()})
        return drawn(rows, rarity, have, turn)

    monkeypatch.setattr(mixing, "_drawn", seen)
    models = []
    for early in (8, 0):
        monkeypatch.setattr(mixing, "EARLY", early, raising=False)
        looked.clear()
        begun.clear()
        models.append((mixing.learn_topics(docs, topics=3), list(looked), begun[-1]))
    (few, rows_few, begun_few), (all_, rows_all, begun_all) = models
    assert len(rows_few) == 3 and max(rows_few) < 400
    assert rows_all == [0, 3500] * 3
    assert all(np.array_equal(begun_few[fit], begun_all[fit]) for fit in begun_all)
    assert np.allclose(few, all_, atol=1e-5)


def test_mixing_edges(docs, empty):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(ALL) + 1 and all(0 <= r.prob <= 1 and r.sampled is not None and 0 <= r.target_error for r in rows)
    assert mixing.mix(empty).collect() == []
    whole = mixing.mix(docs, share=1.0).collect()
    assert sum(r.tokens * r.prob for r in whole) <= sum(r.tokens for r in whole) + 1e-6


def _scorer(**kind):
    return toxicity.Scorer(toxicity.Model({"moron": False, "worthless": False}, weights=np.array([3.0, 3.0, 1.0, 0.5, -4.0]), **kind))


def test_quoted_and_misspelled_hits_count_less():
    plain, quoted, once, alone = _scorer().scores(["you are a moron here", 'he wrote "you are a moron" here', "you are a morron here", "you are a person here"])
    assert plain > once > alone and plain > quoted > alone
    f = _scorer().features(["a moron", 'the "moron" word', "a morron", 'the "morron" word', 'open " moron " shut', 'said " so. moron was "'])
    assert np.allclose(np.expm1(f[:, 0]), [1, 0.25, 0.5, 0.125, 0.25, 0.25])
    company = _scorer().features(["moron and worthless", 'says "moron and worthless"', "moron"])[:, 3]
    assert company[0] > 0 and company[1] == company[2] == 0


def test_weak_stems_need_several_words():
    s = _scorer(weak=frozenset({"bomente"}))
    f = np.expm1(s.features(["bomentera de", "bomentera bomentera", "bomentera y bomentes", "bomentera bomentes bomentell", None, ""])[:, 1])
    assert np.allclose(f, [0, 0, 1, 2, 0, 0])


def test_lexicon_learns_words_stems_and_weak_stems():
    r = random.Random(3)
    ends = ["ab", "ec", "id", "of", "ug", "ax", "en", "il", "ot", "uz"]
    texts, labels = [], []
    for i in range(400):
        words = prose(i, 40).split()
        y = i % 4 == 0
        put = ["grobian"] * (i % 8 == 0) + [f"schurk{r.choice(ends)}"] * (i % 8 == 4) + ([f"zanket{e}" for e in r.sample(ends, 3)] if y else [f"zanket{r.choice(ends)}"] * (i % 5 == 0))
        for w in put:
            words.insert(r.randrange(len(words)), w)
        texts.append(" ".join(words))
        labels.append(int(y))
    terms, weak = toxicity.lexicon(texts, np.array(labels))
    assert "zanket" in weak and "schurk" not in weak and "zanket" not in terms
    model = toxicity.fit(texts, np.array(labels), 0.25)
    got = toxicity.Scorer(model).scores(texts + texts[:4])
    assert ((got[:400] >= 0.7) == np.array(labels, bool)).mean() > 0.99 and np.allclose(got[400:], got[:4])
