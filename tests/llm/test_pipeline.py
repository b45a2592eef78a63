import os

import pytest

import corpus_pipeline
from rasterloom.llm import common, minhash, mixing, quality_crf, registry
from tests.llm.test_dedup import brute_components, shingles

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")
def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
        assert 0 < len(kept[name]) <= before
        before = len(kept[name])
    norm = lambda t: "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")
    best = {}
    for i, t in sorted(kept["quality classifier"].items()):
        if norm(t) not in best or len(t or "") > len(best[norm(t)][1] or ""):
            best[norm(t)] = i, t
    assert kept["exact dedup"] == dict(best.values())
    want = brute_components({i: shingles(t) for i, t in kept["exact dedup"].items()}, corpus_pipeline.NEAR_PERCENT)
    assert set(kept["MinHash near-dedup"]) == {i for i, c in want.items() if i == c}
    last = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in last} == set(kept["mixing to target weights"])
    assert all(r.round_trip for r in last)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")
def test_quality_and_mixing_stages_by_plain_code(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality_crf.learn(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = docs.collect()
    scores = model.scores([r.text for r in rows])
    assert {r.doc_id for r in corpus_pipeline.quality(spark, docs, SF).collect()} == {r.doc_id for r, s in zip(rows, scores, strict=True) if s >= quality_crf.THRESHOLD}
    # cells raked and scaled by plain loops, then the draw
    cell, tokens, draw = {}, {}, {r.doc_id: r.u for r in docs.select("doc_id", mixing.draw().alias("u")).collect()}
    for r in mixing.described(docs).collect():
        cell[r.doc_id] = (r.source, r.lang, r.topic)
        tokens[cell[r.doc_id]] = tokens.get(cell[r.doc_id], 0) + max(1, r.tokens)
    total = sum(tokens.values())
    weight = {c: t / total for c, t in tokens.items()}
    targets = []
    for k in range(3):
        sums = {}
        for c, t in tokens.items():
            sums[c[k]] = sums.get(c[k], 0) + t
        flat = {v: t**mixing.POWER for v, t in sums.items()}
        targets.append({v: f / sum(flat.values()) for v, f in flat.items()})
    for _ in range(3000):
        for k, target in enumerate(targets):
            sums = {}
            for c, w in weight.items():
                sums[c[k]] = sums.get(c[k], 0) + w
            weight = {c: w * target[c[k]] / sums[c[k]] if sums[c[k]] else 0.0 for c, w in weight.items()}
    lo, hi = 0.0, 1e12  # the scale at which the expected tokens are the wanted share
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(tokens[c], mid * weight[c]) for c in tokens) < mixing.SHARE * total else (lo, mid)
    want = {i for i, c in cell.items() if draw[i] < min(1.0, hi * weight[c] / tokens[c])}
    got = {r.doc_id for r in corpus_pipeline.mixed(spark, docs, SF).collect()}
    assert len(got ^ want) <= 1 and got  # a draw may lie at the edge of a probability


def test_stages_on_awkward_rows(spark, docs, empty):
    """Nulls, no ids, repeated rows and clashing columns; empty tables."""
    whole = docs.unionByName(docs.filter("doc_id = 9").selectExpr("CAST(NULL AS BIGINT) AS doc_id", *docs.columns[1:]))
    kept = corpus_pipeline.exact(spark, whole, SF).collect()
    ids = [r.doc_id for r in kept]
    assert len(ids) == len(set(ids)) and None in ids and kept[0].__fields__ == docs.columns
    for stage in (corpus_pipeline.near, corpus_pipeline.mixed):
        got = stage(spark, whole, SF)
        assert got.columns == docs.columns and None in [r.doc_id for r in got.collect()]
    for stage in (corpus_pipeline.exact, corpus_pipeline.near, corpus_pipeline.mixed, corpus_pipeline.encoded):
        assert stage(spark, empty, SF).collect() == []
    if os.path.isdir(SF):
        assert corpus_pipeline.quality(spark, empty, SF).collect() == []


@pytest.mark.parametrize("bits", [3, 7, 27])
def test_rows_without(spark, docs, bits, monkeypatch):
    """No mark, nearly all marked, and more ids than bits; a null id, an id of another type, clashing columns b, k and id."""
    monkeypatch.setattr(common, "MARK_BITS", bits)
    many = spark.range(200).selectExpr("nullif(id, 150) AS doc_id", "concat('t', id) AS text", "1 AS b", "'x' AS k", "id")
    for gone in ([], [None], [4], list(range(0, 200, 3)), list(range(200))):
        ids = spark.createDataFrame([(i,) for i in gone + gone[:1]], "doc_id int")
        got = common.without(many, ids)
        assert got.columns == many.columns
        assert sorted(r.id for r in got.collect()) == [i for i in range(200) if i not in gone or i == 150]
    assert common.without(docs, docs.filter("doc_id = 6")).count() == docs.filter("doc_id != 6").count()


def test_registered():
    assert {f"op{n}_" for n in range(1, 11)} <= {q.split("_")[0] + "_" for q in registry.QUERIES}
    assert "pipeline" in registry.QUERIES and set(registry.ORACLE_SQL) <= set(registry.QUERIES)


def test_near_stage_drops_copies_from_80_percent(spark):
    """Copies of 0.79, 0.80, 0.84 and 0.86, and short ones of which only 80 percent can agree."""
    long = [f"w{i}" for i in range(104)]
    texts = {1: long[:84], 2: long, 3: [f"x{i}" for i in range(84)], 5: [f"y{i}" for i in range(90)], 7: [f"z{i}" for i in range(83)], 9: [f"s{i}" for i in range(8)]}
    texts |= {4: texts[3] + [f"v{i}" for i in range(15)], 6: texts[5] + [f"v{i}" for i in range(14)], 8: texts[7] + [f"v{i}" for i in range(21)], 10: texts[9] + ["tail"]}
    sets = {i: shingles(" ".join(w)) for i, w in texts.items()}
    near = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert [round(near(i, i + 1), 2) for i in (1, 3, 5, 7, 9)] == [0.80, 0.84, 0.86, 0.79, 0.8]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.near(spark, docs, SF).collect()} == {1, 3, 5, 7, 8, 9}


def test_bands_follow_the_threshold():
    assert [(minhash.BINS // r, r) for r in map(minhash.band_rows, (85, 80))] == [(48, 8), (64, 6)]
    for percent in (70, 80, 85, 95):
        r = minhash.band_rows(percent)
        assert (1 - (percent / 100) ** r) ** (minhash.BINS // r) <= minhash.MISSED
