"""Near-duplicate groups by one-permutation MinHash.

A document's set is its distinct five-word shingles (64-bit hashes). Equal sets are one class from the start. One
permutation hash of a class fills BINS bins with the lowest hash in each; an empty bin borrows from the bin that its
own hash sequence names first (optimal densification). Bands of bins make buckets; a bucket links its members to a
centre, a star, so candidates grow with members and not with their square. Candidates are confirmed on full sets.

The centre is the member that shares most over all its buckets, to which most of a group links. A star alone would
lose links between members that are not the centre's. So the members of buckets that still hold more than one
component go through an exact similarity join: each names its rarest shingles, as many as cannot all be missing from a
set that reaches the threshold (a prefix in the order of frequency), and whoever shares one of those is in one group.
Boilerplate is frequent and so in nobody's prefix. Groups with more than one component are compared in blocks of a
bounded number of shingles, and a task returns a spanning forest of its links.

Texts are read twice and never shuffled: the second reading makes sets only for documents that have a candidate, told
by a bounded lossy set of ids, and joins are exact after it.

The width of the bands follows from the threshold: a pair at it misses every band with a chance below MISSED (up to
1e-5 for small sets, whose bins repeat). 85 percent has 48 bands of 8, 80 percent 64 of 6. Sets too small for any
different set to reach the threshold get no bands.

Cases: null, empty or blank text has no set and is alone; text of fewer than five words is one shingle; an empty
table gives no rows; repeated rows are in one class; a row without an id is in the class of its set, but a class
without any id has no links; other columns are not read. doc_id must identify a text.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.llm.common import Marks, discard, keep, pieces, texts_of
from rasterloom.llm.components import components
from rasterloom.llm.vocab import Words

SHINGLE, PERCENT = 5, 85
BINS, MISSED = 384, 1e-6
#: Groups are compared in blocks of about BLOCK members and SHINGLES shingles, COLUMNS shingles at a time.
BLOCK, SHINGLES, COLUMNS = 400, 1 << 18, 4096
_STEP = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(text: str) -> list[bytes]:
    """A-Z lower-cased, cut at the six white-space bytes: bytes.lower() and bytes.split() know ASCII alone."""
    return text.encode().lower().split()


class Shingler:
    def __init__(self):
        self.words, self.hashes = Words(), np.zeros(0, np.uint64)

    def sets(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The sorted distinct shingle hashes of each text."""
        if self.words.begin():
            self.hashes = self.hashes[:0]
        places, offsets, new = self.words.of(texts, words_of)
        self.hashes = np.concatenate([self.hashes, np.fromiter(map(xxhash.xxh64_intdigest, new), np.uint64, len(new))])
        h = self.hashes[places]
        full = len(h) - SHINGLE + 1
        s = mix(sum((h[i : i + full] * _STEP[i] for i in range(1, SHINGLE)), h[:full] * _STEP[0])) if full > 0 else h[:0]
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            if b - a >= SHINGLE:
                yield np.unique(s[a : b - SHINGLE + 1])
            elif b > a:
                short = np.full(1, b - a, np.uint64)
                for i in range(a, b):
                    short = mix(short * _STEP[1] + h[i : i + 1])
                yield short
            else:
                yield h[:0]


_STARTS = ((np.arange(BINS, dtype=object) << 64) // BINS + 1).astype(np.uint64)
_STARTS[0] = 0


def signature(s: np.ndarray) -> np.ndarray:
    """The lowest hash in each bin; bins are ranges of the hash, so it is the first at or after the start of the range."""
    at = np.searchsorted(s, _STARTS)
    full = at < np.append(at[1:], len(s))
    out = s[np.minimum(at, len(s) - 1)]
    empty, t = np.flatnonzero(~full), 0
    while len(empty):
        t += 1
        source = (mix(empty.astype(np.uint64) * _STEP[0] + np.uint64(t)) % np.uint64(BINS)).astype(np.int64)
        ok = full[source]
        out[empty[ok]] = out[source[ok]]
        empty = empty[~ok]
    return out


@functools.cache
def band_rows(percent: int) -> int:
    """Bins in a band: the most at which a pair at the threshold still meets in some band."""
    return max((r for r in range(1, BINS + 1) if (1 - (percent / 100) ** r) ** (BINS // r) <= MISSED), default=1)


def _bands(sig: np.ndarray, rows: int) -> np.ndarray:
    many = BINS // rows
    x = sig[: many * rows].reshape(many, rows)
    h = np.arange(1, many + 1, dtype=np.uint64)
    for i in range(rows):
        h = mix(h * _STEP[2] + x[:, i])
    return h.astype(np.int64)


def band_keys(s: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    n = len(s)
    if 100 * n < percent * (n + 1):  # even a set of one more falls short
        return np.zeros(0, np.int64)
    return _bands(signature(s), band_rows(percent))


def _scan(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))


def signatures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """doc_id, n, s1, s2 (with n: the set's 128-bit name), bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in pieces(batches, "text"):
            n, s1, s2, bands = [], [], [], []
            for s in shingler.sets(texts_of(batch, "text")):
                n.append(len(s))
                s1.append(np.bitwise_xor.reduce(mix(s)).astype(np.int64) if len(s) else 0)
                s2.append(np.sum(mix(s * _STEP[1]), dtype=np.uint64).astype(np.int64) if len(s) else 0)
                bands.append(band_keys(s, percent))
            ends = np.concatenate([[0], np.cumsum([len(b) for b in bands])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(bands)))
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), lists], ["doc_id", "n", "s1", "s2", "bands"])

    return _scan(docs, doc_id, text).mapInArrow(run, "doc_id long, n long, s1 long, s2 long, bands array<long>")


def _sets(docs: DataFrame, wanted: Marks) -> DataFrame:
    """doc_id, n, s: the sets of documents whose ids are marked, made where the texts are read."""
    sent = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            held = batch.filter(pa.array(sent.value.hold(batch.column(2).to_numpy())))
            for part in pieces(iter([held]), "text"):
                sets = list(shingler.sets(texts_of(part, "text")))
                yield pa.record_batch([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["doc_id", "n", "s"])

    return docs.select("doc_id", "text", F.xxhash64("doc_id").alias("h")).mapInArrow(run, "doc_id long, n long, s binary")


def _members(sig: DataFrame, shared: Marks) -> DataFrame:
    """key, d, n of the bands whose keys are marked."""
    sent = sig.sparkSession.sparkContext.broadcast(shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(2).flatten().to_numpy()
            good = np.flatnonzero(sent.value.hold(keys))
            row = np.repeat(np.arange(batch.num_rows), np.array(batch.column(2).value_lengths()))[good]
            yield pa.record_batch([pa.array(keys[good]), batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row))], ["key", "d", "n"])

    return sig.select("doc_id", "n", "bands").mapInArrow(run, "key long, d long, n long")


def _shingles(sets: DataFrame, wanted: Marks) -> DataFrame:
    """h, d, n: each shingle of the documents that are marked."""
    sent = sets.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.filter(pa.array(sent.value.hold(batch.column(3).to_numpy())))
            for d, n, s in zip(held.column(0).to_pylist(), held.column(1).to_pylist(), held.column(2).to_pylist(), strict=True):
                h = np.frombuffer(s, np.int64)
                for i in range(0, len(h), 1 << 16):
                    part = h[i : i + (1 << 16)]
                    yield pa.record_batch([pa.array(part), pa.array(np.full(len(part), d)), pa.array(np.full(len(part), n))], ["h", "d", "n"])

    return sets.select("doc_id", "n", "s", F.xxhash64("doc_id").alias("m")).mapInArrow(run, "h long, d long, n long")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sa, sb = batch.column(2), batch.column(3)
            good = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = np.frombuffer(sa[i].as_buffer(), np.uint64), np.frombuffer(sb[i].as_buffer(), np.uint64)
                both = np.concatenate([x, y])
                both.sort()
                inter = int(np.count_nonzero(both[1:] == both[:-1]))
                good[i] = 100 * inter >= percent * (len(both) - inter)
            yield batch.select([0, 1]).filter(pa.array(good))

    by = lambda name: sets.select(F.col("doc_id").alias(name), F.col("s").alias(f"s{name}"))
    both = pairs.join(by("b"), "b").join(by("a"), "a").select("a", "b", "sa", "sb")
    return both.mapInArrow(run, "a long, b long")


def _fits(n: str, m: str, percent: int):
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def _pair(x: str, y: str):
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _with(found: DataFrame, links: DataFrame) -> DataFrame:
    """Components with links added."""
    return found if links.isEmpty() else keep(components(found.select(F.col("node").alias("a"), F.col("label").alias("b")).unionAll(links)))


def _alike(rows: DataFrame, percent: int) -> DataFrame:
    """node, label: groups of documents that share a rare shingle, from h, d, n rows.

    Of a set of n, ceil(n * percent / 100) shingles at least are common with any set that reaches the threshold. So the
    rarest n - ceil(...) + 1 of both hold a common one; shingles of one document alone come first and join nobody."""
    often = keep(rows.groupBy("h").agg(F.count("*").alias("many")).filter("many > 1"))
    own = Window.partitionBy("d")
    shared = keep(rows.join(often, "h").select("d", "h", "n", "many"))  # alone, so that the join on a common shingle can be split
    ranked = shared.select("d", "h", F.row_number().over(own.orderBy("many", "h")).alias("at"), (F.count("*").over(own) - F.expr(f"({percent} * n + 99) div 100") + 1).alias("first"))
    prefix = keep(ranked.filter("at <= first").select("d", "h"))
    centre = keep(prefix.groupBy("h").agg(F.min("d").alias("c")))  # alone for the same reason
    groups = keep(components(prefix.join(centre, "h").filter("d != c").select(F.col("d").alias("a"), F.col("c").alias("b"))))
    discard(often, shared, prefix, centre)
    return groups


def _forest(ids: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that join whatever reaches the threshold among these sets; at most one fewer than there are sets.

    Counts of common shingles are products of columns of the incidence matrix, some thousand columns at a time; a
    shingle that only one of the sets has is left out of them."""
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    values, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    place = np.cumsum(shared) - 1
    held = shared[column]
    owner, column = owner[held], place[column[held]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((len(sets), len(sets)), np.float32)
    for lo in range(0, int(shared.sum()), COLUMNS):
        a, b = np.searchsorted(column, [lo, lo + COLUMNS])
        m = np.zeros((len(sets), COLUMNS), np.float32)
        m[owner[a:b], column[a:b] - lo] = 1
        common += m @ m.T
    near = 100 * common >= percent * (size[:, None] + size[None, :] - common)
    np.fill_diagonal(near, False)
    out, seen = [], np.zeros(len(sets), bool)
    for start in range(len(sets)):
        stack = [start]
        if seen[start]:
            continue
        seen[start] = True
        while stack:
            i = stack.pop()
            for j in np.flatnonzero(near[i] & ~seen).tolist():
                seen[j] = True
                out.append((int(ids[i]), int(ids[j])))
                stack.append(j)
    return [(min(x), max(x)) for x in out]


def _blocks(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links that join each group (node, n, label) wherever full sets reach the threshold.

    A group is dealt into blocks of about BLOCK members, or fewer with SHINGLES shingles, and every two blocks meet in one
    task, so a task holds two blocks whatever the group's size; it returns a spanning forest of its links, not all."""
    many = F.least(F.count("*"), F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / SHINGLES)))
    blocks = groups.groupBy("label").agg(many.cast("int").alias("nb"))
    dealt = groups.join(blocks, "label").select("node", "label", "nb", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int").alias("own"))
    dealt = dealt.select("node", "label", "own", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("other"))
    meet = dealt.select("node", "label", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    rows = meet.join(sets.select(F.col("doc_id").alias("node"), "s"), "node")

    def run(t: pa.Table) -> pa.Table:
        links = _forest(t.column("node").to_numpy(), [np.frombuffer(x, np.uint64) for x in t.column("s").to_pylist()], percent)
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([x for _, x in links], pa.int64())})

    return rows.groupBy("label", "i", "j").applyInArrow(run, "a long, b long").distinct()


def _candidates(sig: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (key, d, n, c, cn) of buckets of two or more, each with its bucket's centre, and their ids."""
    reps = classes.select(F.col("rep").alias("doc_id"), "s1", "s2", "n")
    banded = keep(sig.filter("size(bands) > 0").join(reps, ["doc_id", "s1", "s2", "n"], "left_semi").select("doc_id", "n", "bands"))
    counts = banded.select(F.explode("bands").alias("key")).groupBy("key").agg(F.count("*").alias("many"))
    shared = keep(counts.filter("many > 1"), rows=F.count(F.lit(1)))
    members = keep(_members(banded, Marks(shared, "key", shared.seen["rows"])).join(shared, "key"))
    discard(banded, shared)
    # who shares most is nearest to what a group has in common, and so the centre that most of it links to
    degree = members.groupBy("d").agg(F.sum("many").alias("degree"))
    ranked = keep(members.drop("many").join(degree, "d"))
    centre = F.max(F.struct("degree", F.xxhash64("d").alias("p"), F.col("d").alias("c"), F.col("n").alias("cn")))
    buckets = ranked.groupBy("key").agg(centre.alias("c")).select("key", "c.c", "c.cn")
    out = keep(ranked.join(buckets, "key").select("key", "d", "n", "c", "cn"))
    discard(members, ranked)
    return out, keep(out.groupBy(F.col("d").alias("doc_id")).agg(F.xxhash64("d").alias("h")), rows=F.count(F.lit(1)))


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept."""
    sig = keep(signatures(docs, doc_id, text, percent))
    classes = keep(sig.filter("n > 0").groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("rep")))
    members, wanted = _candidates(sig, classes)
    sets = keep(_sets(_scan(docs, doc_id, text).filter("doc_id IS NOT NULL"), Marks(wanted, "h", wanted.seen["rows"])), rows=F.count(F.lit(1)))
    if sets.seen["rows"] > sets.select("doc_id").distinct().count():  # repeated rows
        sets = keep(sets.dropDuplicates(["doc_id"]))
    tested = members.filter("d != c").filter(_fits("n", "cn", percent)).select(*_pair("d", "c")).distinct()
    links = keep(confirm(tested, sets, percent))
    found = keep(components(links))
    discard(wanted, links)
    # buckets that still hold several components
    now = members.join(found.withColumnRenamed("node", "d"), "d", "left").select("key", "d", "n", F.coalesce("label", "d").alias("own"))
    now = keep(now)
    several = now.groupBy("key").agg(F.min("own").alias("lo"), F.max("own").alias("hi")).filter("lo != hi").select("key")
    open_ = keep(now.join(several, "key").groupBy(F.col("d").alias("node"), "n", "own").agg(F.xxhash64("d").alias("h")), rows=F.count(F.lit(1)))
    discard(members, now)
    if open_.seen["rows"]:
        groups = _alike(_shingles(sets, Marks(open_, "h", open_.seen["rows"])), percent).join(open_.drop("h"), "node")
        mixed = groups.groupBy("label").agg(F.min("own").alias("lo"), F.max("own").alias("hi")).filter("lo != hi").select("label")
        found = _with(found, keep(_blocks(keep(groups.join(mixed, "label").select("node", "n", "label")), sets, percent)))
    discard(open_, sets)
    roots = keep(classes.join(found.select(F.col("node").alias("rep"), "label"), "rep", "left").select("s1", "s2", "n", F.coalesce("label", "rep").alias("root")))
    own = sig.select("doc_id", "s1", "s2", "n").join(roots, ["s1", "s2", "n"], "left")
    return own.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "doc_id").alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
