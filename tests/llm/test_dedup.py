import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.llm import exact_dedup, minhash, suffix_dedup
from rasterloom.llm.common import Marks
from rasterloom.llm.components import components
from tests.llm.conftest import prose, texts

ALL = texts()


def test_exact_against_brute_force(docs):
    norm = {i: re.sub(r"[\x20\x09-\x0D]", "", t or "") for i, t in enumerate(ALL)}
    groups = defaultdict(list)
    for i in [*norm, 6]:
        groups[norm[i]].append(i)
    for digest in (None, lambda c: F.length(c).cast("long")):  # also with names that collide
        got = exact_dedup.exact_groups(docs, digest=digest).collect()
        assert len(got) == len(ALL) + 1
        for r in got:
            own = groups[norm[r.doc_id]]
            best = min(own, key=lambda i: (-len(ALL[i] or ""), i))
            assert (r.keep_id, r.group_size, r.kept) == (best, len(own), best == r.doc_id)
            assert r.text_sha256 == hashlib.sha256(norm[r.doc_id].encode()).hexdigest()


def test_exact_recipes_join_to_the_text(docs):
    rows = exact_dedup.recipes(docs).collect()
    for r in rows:
        assert sum(c.n for c in r.chunks) == len(re.sub(r"[\x20\x09-\x0D]", "", ALL[r.doc_id] or ""))
        assert all(1 <= c.n <= exact_dedup.MAX_CHUNK for c in r.chunks)


def test_exact_cuts_follow_the_text_in_any_script(spark):
    """Chunks of a text and of the same text after a new beginning agree but for the first ones."""
    r = random.Random(2)
    for first, last in ((0x4E00, 0x9FA5), (0x430, 0x44F), (0xAC00, 0xD7A3), (0x3041, 0x3096), (0x905, 0x939), (0x61, 0x7A), (0x41, 0x5A), (0x100, 0x17F), (0x20000, 0x2A6DF), (0x10400, 0x1044F), (0x1F300, 0x1FAFF)):
        text = "".join(chr(r.randrange(first, last)) for _ in range(30_000))
        rows = spark.createDataFrame([(0, text), (1, "x" * 7 + text)], "doc_id long, text string")
        a, b = ([c.h for c in r.chunks] for r in exact_dedup.recipes(rows).orderBy("doc_id").collect())
        assert len(a) > 20 and len(set(a) & set(b)) > 0.8 * len(a)


def test_exact_least_id_and_no_id(spark):
    least = -(1 << 63)
    rows = [(least, "a b"), (0, "ab"), (None, "ab "), (None, "c"), (least, "a b")]
    got = exact_dedup.exact_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in got) == sorted([(str(least), str(least), 4, True)] * 2 + [("0", str(least), 4, False), ("None", str(least), 4, False), ("None", "None", 1, True)])


def test_exact_names_that_clash(spark):
    """Doubt goes with the recipe: repeated and missing ids of different texts do not matter."""
    rows = [(1, "aaa"), (1, "bbb"), (2, "bbb"), (None, "aaa"), (None, "ccc"), (3, "d" * 9000), (3, "e" * 9000), (4, "d" * 9000)]
    got = exact_dedup.exact_groups(spark.createDataFrame(rows, "doc_id long, text string"), digest=lambda c: F.length(c).cast("long")).collect()
    sha = {t: hashlib.sha256(t.encode()).hexdigest() for _, t in rows}
    keepers = {"aaa": (1, 2), "bbb": (1, 2), "ccc": (None, 1), "d" * 9000: (3, 2), "e" * 9000: (3, 1)}
    want = sorted((str(i), str(keepers[t][0]), keepers[t][1], i == keepers[t][0], sha[t]) for i, t in rows)
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in got) == want


def test_exact_empty(empty):
    assert exact_dedup.exact_groups(empty).collect() == []


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute_components(sets, percent=85):
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j]:
                common = len(sets[i] & sets[j])
                if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                    a, b = find(i), find(j)
                    root[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


def test_near_against_brute_force(docs):
    sets = {i: shingles(t) for i, t in enumerate(ALL)}
    want = brute_components(sets)
    got = minhash.near_groups(docs).collect()
    assert len(got) == len(ALL) + 1
    for r in got:
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)


def varied(seed, n):
    """Copies of one text with more or fewer words changed: a crowd in which some reach the threshold and some don't."""
    r, base, out = random.Random(seed), prose(9, 150).split(), []
    for _ in range(n):
        w = list(base)
        for _ in range(r.randrange(0, 7)):
            w[r.randrange(len(w))] = f"w{r.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("seed", "block"), [(5, 20), (6, 400)])
def test_near_crowd_loses_no_link(spark, monkeypatch, seed, block):
    """In several blocks and in one."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    crowd = varied(seed, 150)
    want = brute_components({i: shingles(t) for i, t in enumerate(crowd)})
    assert 1 < len(set(want.values())) < len(crowd)
    rows = minhash.near_groups(spark.createDataFrame(list(enumerate(crowd)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in rows} == want


def test_near_prefixes_share_a_rare_shingle(spark):
    """Whoever reaches the threshold is in one group, and boilerplate that all hold makes none."""
    r, common = random.Random(4), list(range(1, 71))
    own = [r.sample(range(1000, 10**6), 30) for _ in range(40)]
    sets = {i: sorted({*common, *own[i // 2], *([10**7 + i] if i % 2 else [])}) for i in range(80)}
    rows = spark.createDataFrame([(h, d, len(s)) for d, s in sets.items() for h in s], "h long, d long, n long")
    groups = {r.node: r.label for r in minhash._alike(rows, 85).collect()}
    assert groups == {i: i // 2 * 2 for i in range(80)}


def test_near_without_ids(spark):
    text, other = prose(3, 60), prose(8, 60)
    rows = [(None, text), (7, text), (None, other), (9, other + " end"), (7, text)]
    got = minhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in got) == [(0, 0, True), (0, 7, False), (7, 7, True), (7, 7, True), (9, 9, True)]


def test_marks_hold_all_they_were_given(spark):
    ids = spark.range(0, 3000, 3).selectExpr("xxhash64(id) AS h")
    marks = Marks(ids, "h", 1000)
    every = np.array([r.h for r in spark.range(3000).selectExpr("xxhash64(id) AS h").collect()])
    held = marks.hold(every)
    assert held[::3].all() and held.sum() < 1200


def test_near_empty(empty):
    assert minhash.near_groups(empty).collect() == []


def test_signature_estimates_similarity():
    r = np.random.default_rng(0)
    for n in (12, 100, 2000):
        got = []
        for _ in range(20):
            x = r.integers(0, (1 << 64) - 1, n + n // 10, dtype=np.uint64)
            a, b = np.sort(x[:n]), np.sort(x[n // 10 :])
            got.append((minhash.signature(a) == minhash.signature(b)).mean())
        assert abs(np.mean(got) - (n - n // 10) / (n + n // 10)) < 0.05


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(20, 60)] + [(5, j) for j in range(100, 130)] + [(130, 129), (7, 7)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 20 for i in range(20, 61)}, **{j: 5 for j in [5, *range(100, 131)]}}


def brute_repeats(rows):
    seen, out = set(), {}
    for i, data in sorted(rows.items()):
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - 99):
            w = data[p : p + 100]
            if w in seen:
                gone[p : p + 100] = True
            seen.add(w)
        rest = bytes(np.frombuffer(data, np.uint8)[~gone])
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[i] = (len(data), int(gone.sum()), spans, hashlib.sha256(rest).hexdigest())
    return out


def _check_repeats(df, rows):
    want = brute_repeats(rows)
    got = suffix_dedup.repeated(df).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want
    return got


def test_repeats_against_brute_force(docs):
    assert len(_check_repeats(docs, {i: (t or "").encode() for i, t in enumerate(ALL)})) == len(ALL) + 1


def test_repeats_with_shared_passages(spark):
    r, passage = random.Random(3), prose(4, 60)
    rows = {}
    for i in range(40):
        a, b = sorted(r.randrange(len(passage)) for _ in range(2))
        rows[i] = f"{prose(100 + i, r.randrange(30))}{passage[a:b]}{prose(200 + i, r.randrange(30))}{passage[: r.randrange(200)]}"
    rows[40], rows[41] = "ab" * 400, "ab" * 300 + "c" + "ab" * 99
    _check_repeats(spark.createDataFrame(list(rows.items()), "doc_id long, text string"), {i: t.encode() for i, t in rows.items()})


def test_repeats_with_more_contexts_than_meet_in_one_place(spark):
    passage = prose(5, 40)
    rows = {i: f"{prose(300 + i, 3)} {passage} {prose(900 + i, 3)}" for i in range(3 * suffix_dedup.FEW)}
    _check_repeats(spark.createDataFrame(list(rows.items()), "doc_id long, text string"), {i: t.encode() for i, t in rows.items()})


def test_ranges_join_consecutive_windows():
    doc, at = np.array([2, 1, 1, 1, 2] + [3] * 450), np.array([9, 5, 4, 7, 10, *range(450)])
    d, r = suffix_dedup._ranges(doc, at)
    assert list(zip(d.tolist(), (r >> 8).tolist(), (r & 255).tolist(), strict=True)) == [(1, 4, 1), (1, 7, 0), (2, 9, 1), (3, 0, 199), (3, 200, 199), (3, 400, 49)]


def test_repeats_without_ids_lose_nothing(spark):
    text = prose(4, 60)
    rows = [(None, text), (3, text), (4, "x" + text), (None, text)]
    got = suffix_dedup.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute_repeats({3: text.encode(), 4: ("x" + text).encode()})
    whole = (len(text), 0, 0, hashlib.sha256(text.encode()).hexdigest())
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want.get(r.doc_id, whole)


def test_repeats_of_a_passage_in_every_document(spark, monkeypatch):
    """A batch for each document and buckets of ten rows: one token fills several buckets."""
    monkeypatch.setattr(suffix_dedup, "BATCH", 400)
    monkeypatch.setattr(suffix_dedup, "BUCKET", 10)
    passage = prose(5, 50)
    rows = {i: f"{prose(300 + i, 4)} {passage} {prose(400 + i, 3)}" for i in range(60)}
    _check_repeats(spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(8), {i: t.encode() for i, t in rows.items()})


def test_repeats_of_windows_that_fill_many_buckets(spark, monkeypatch):
    """More contexts than meet in one place, a batch a document, buckets of ten windows, and lists that are sorted."""
    monkeypatch.setattr(suffix_dedup, "BATCH", 400)
    monkeypatch.setattr(suffix_dedup, "BUCKET", 10)
    monkeypatch.setattr(suffix_dedup, "FEW", 4)
    monkeypatch.setattr(suffix_dedup, "HASHED", -1)
    monkeypatch.setattr(suffix_dedup, "NARROWED", 500)
    passage = prose(6, 30)[:150]
    rows = {i: f"{prose(500 + i, 2)} {passage} {prose(700 + i, 2)}" for i in range(40)}
    pairs = [*rows.items(), (7, rows[7]), (None, rows[8])]
    got = suffix_dedup.repeated(spark.createDataFrame(pairs, "doc_id long, text string").repartition(8)).collect()
    want = brute_repeats({i: t.encode() for i, t in rows.items()})
    assert all((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id] for r in got if r.doc_id is not None)
    assert len(got) == 42 and sum(r.n_removed > 0 for r in got) >= 39


def test_repeats_empty(empty):
    assert suffix_dedup.repeated(empty).collect() == []


def test_multikey_order():
    r = np.random.default_rng(1)
    cols = [r.integers(0, 3, 9000), r.integers(0, 50, 9000), r.integers(0, 1000, 9000)]
    order = suffix_dedup.multikey_order(cols, few=16)
    rows = list(zip(*(c[order].tolist() for c in cols), strict=True))
    assert rows == sorted(rows) and sorted(order.tolist()) == list(range(9000))
