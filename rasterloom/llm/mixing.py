"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of (source, language, topic). A topic is a component of a mixture of unigram models, fitted
by expectation maximisation on all documents and applied to every one of them. The cells' token weights are raked:
each marginal in turn is scaled to its target until all three are met within TOLERANCE, or until rounds bring them no
nearer (targets that contradict each other through empty cells). A document's probability is its cell's raked tokens
over its tokens, times one scale for the wanted total; where that passes 1 the cell is taken whole and the scale of the
others rises. The draw compares the probability with a hash of the id, so it repeats.

Up to FEW_CELLS cells are raked as arrays on the driver; more, as for millions of sources, stay a DataFrame and are
raked by aggregates and joins, to the same weights. Targets are shares of tokens by value; the default flattens each
marginal, share ** POWER, so small sources gain.

Cases: null source, language or topic is a value of its own; documents without words have topic -1 and weigh one token;
a target for a value that no document has is left out and the rest is scaled up; a value without a target gets no
weight; ties between topics fall to the first; repeated ids draw alike; a null id draws as one; an empty table gives
no rows. report() has each marginal, its target and what it came to.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import keep, pieces, texts_of

POWER, SHARE = 0.7, 0.6
DIMENSIONS = ["source", "lang", "topic"]
#: Raking ends when every marginal is this near to its target, as a share of all tokens, or when a round gains nothing.
TOLERANCE, MOST_ROUNDS = 1e-9, 1000
FEW_CELLS = 200_000
#: Topics are fitted to counts of words hashed to so many places. The likeliest of RESTARTS fits after TRIED rounds goes on.
TOPICS, PLACES, FIT_ROUNDS, RESTARTS, TRIED = 8, 2048, 40, 4, 5
#: Texts of which a worker holds dense counts at once, and the unit of sums, which as integers are exact in any order.
DENSE, UNIT = 512, float(1 << 20)
#: About so many texts have a lot for one draw that is low enough to be looked at first.
EARLY = 64
#: An entry is the place of some of a text's words and, PLACES times, their count, in 16 bits. Counts from MANY on are 0 there
#: and stand apart, in the same order.
MANY = (1 << 16) // PLACES
#: What is kept of each text: its entries, how many words there are, and the least of its lots.
COUNTED = "doc_id long, source string, lang string, key long, size long, entries binary, many binary, lot double"


def places_of(word: str) -> int:
    return xxhash.xxh32_intdigest(word.lower()) % PLACES


def _xxh32(data: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """xxh32 of the stretches of bytes of one size, below 16, from starts."""
    p1, p2, p3, p4, p5 = map(np.uint32, (2654435761, 2246822519, 3266489917, 668265263, 374761393))
    turned = lambda x, by: (x << np.uint32(by)) | (x >> np.uint32(32 - by))
    own = data[starts[:, None] + np.arange(size)]
    h = np.full(len(starts), (374761393 + size) % (1 << 32), np.uint32)
    for lane in own[:, : size & ~3].copy().view("<u4").T:
        h = turned(h + lane * p3, 17) * p4
    for byte in own[:, size & ~3 :].T:
        h = turned(h + byte * p5, 11) * p1
    h = (h ^ (h >> np.uint32(15))) * p2
    h = (h ^ (h >> np.uint32(13))) * p3
    return h ^ (h >> np.uint32(16))


def words_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text of each word, its place as of places_of(), words in each text).

    Texts are split, and words of one length hashed, as arrays: a text in lower case has the words of the text in lower
    case, and a table of the distinct words, most of which are rare, would cost more than hashing each again."""
    lists = pc.utf8_split_whitespace(pa.array([t.lower() if t else "" for t in texts], pa.string()))
    words = lists.values
    ends = np.frombuffer(words.buffers()[1], np.int32)[: len(words) + 1]
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    sizes, text = np.diff(ends), np.repeat(np.arange(len(texts)), np.diff(np.asarray(lists.offsets)))
    starts, text, sizes = ends[:-1][sizes > 0], text[sizes > 0], sizes[sizes > 0]  # white space at an end leaves an empty word
    place = np.zeros(len(sizes), np.int64)
    order = np.argsort(np.minimum(sizes, 16).astype(np.uint8), kind="stable")
    cuts = np.searchsorted(np.minimum(sizes, 16)[order], np.arange(1, 17))
    for size in range(1, 16):
        at = order[cuts[size - 1] : cuts[size]]
        if len(at):
            place[at] = _xxh32(data, starts[at], size) % np.uint32(PLACES)
    for k in order[cuts[15] :].tolist():
        place[k] = xxhash.xxh32_intdigest(data[starts[k] : starts[k] + sizes[k]]) % PLACES
    return text, place, np.bincount(text, minlength=len(texts))


def fit_topics(texts: list[str | None], topics: int = TOPICS, rounds: int = FIT_ROUNDS) -> np.ndarray:
    """(PLACES + 1, topics): log probabilities of words by topic, and in the last row those of the topics.

    A mixture of unigram models. Texts count by the square root of each word's count, so that long ones do not rule. It
    begins from texts drawn by their distance from those drawn before (rare words weigh more), and the likeliest of
    RESTARTS fits is taken."""
    doc, place, size = words_of(texts)
    x = np.zeros((len(texts), PLACES), np.float32)
    np.add.at(x, (doc, place), 1)
    x = np.sqrt(x[size > 0])
    if not len(x):
        return np.zeros((PLACES + 1, 1))
    rare = x * np.log((1 + len(x)) / (1 + (x > 0).sum(0)))
    unit = rare / np.maximum(np.linalg.norm(rare, axis=1, keepdims=True), 1e-9)
    best, top = None, -np.inf
    for seed in range(RESTARTS):
        r = np.random.default_rng(seed)
        chosen = [int(r.integers(len(x)))]
        near = unit @ unit[chosen[0]]
        while len(chosen) < min(topics, len(x)) and near.min() < 1 - 1e-6:
            far = np.maximum(1 - near, 0) ** 2
            chosen.append(int(r.choice(len(x), p=far / far.sum())))
            near = np.maximum(near, unit @ unit[chosen[-1]])
        own = np.exp(8 * (unit @ unit[chosen].T))
        own /= own.sum(1, keepdims=True)
        like = -np.inf
        for _ in range(rounds):
            p = x.T @ own + 0.05
            model = np.vstack([np.log(p / p.sum(0)), np.log((own.sum(0) + 1e-3) / (own.sum() + 1e-3 * own.shape[1]))])
            z = x @ model[:-1] + model[-1]
            most = z.max(1, keepdims=True)
            own = np.exp(z - most)
            before, like = like, float((most[:, 0] + np.log(own.sum(1))).sum())
            own /= own.sum(1, keepdims=True)
            if like - before < 1e-6 * abs(like):
                break
        if like > top:
            best, top = model, like
    return best


def _binaries(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Stretches of values as binaries, which Spark copies as a whole where it would take arrays apart."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * values.itemsize).astype(np.int32)), pa.py_buffer(values)])


def _stretches(found: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The values of all binaries of a column end to end, and how many each has."""
    ends = np.frombuffer(found.buffers()[1], np.int32)[found.offset : found.offset + len(found) + 1]
    data = found.buffers()[2]
    values = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data else np.zeros(0, np.uint8)
    return values.view(kind), np.diff(ends) // np.dtype(kind).itemsize


def counted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang") -> DataFrame:
    """doc_id, source, lang, a hash of the text (key), its number of words (size), its entries, and its least lot of all
    draws. Texts are split once; what is fitted and applied reads this table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draws = np.array([_seed(fit, turn) for fit in range(RESTARTS) for turn in range(TOPICS)])
        for batch in pieces(batches, "text"):
            doc, place, size = words_of(texts_of(batch, "text"))
            keys, n = np.unique(doc * PLACES + place, return_counts=True)
            ends = np.searchsorted(keys, np.arange(len(size) + 1) * PLACES)
            apart = n >= MANY
            entries = (keys % PLACES + PLACES * np.where(apart, 0, n)).astype(np.uint16)
            lists = [_binaries(entries, ends), _binaries(n[apart].astype(np.int32), np.append(0, np.cumsum(apart))[ends])]
            lot = pa.array(_lots(batch.column(3).to_numpy(), draws).min(0))
            yield pa.record_batch([*batch.columns[:4], pa.array(size.astype(np.int64)), *lists, lot], ["doc_id", "source", "lang", "key", "size", "entries", "many", "lot"])

    cols = [F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), F.col(lang).cast("string").alias("lang")]
    return docs.select(*cols, F.xxhash64(text).alias("key"), F.col(text).alias("text")).mapInArrow(run, COUNTED)


def _read(entries: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and counts."""
    counts = (entries // PLACES).astype(np.int32)
    counts[counts == 0] = many
    return entries % PLACES, counts


def _entries(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of counted texts (text of each entry, place, count)."""
    entries, n = _stretches(batch.column(batch.schema.get_field_index("entries")), np.uint16)
    many, _ = _stretches(batch.column(batch.schema.get_field_index("many")), np.int32)
    return np.repeat(np.arange(len(n)), n), *_read(entries, many)


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of counted texts with the roots of their counts, (texts, PLACES), a bounded number at a time and all in the same
    memory: they are void once the next are asked for."""
    x = np.zeros((DENSE, PLACES), np.float32)
    flat = x.reshape(-1)
    for whole in batches:
        for i in range(0, whole.num_rows, DENSE):
            batch = whole.slice(i, DENSE)
            text, places, counts = _entries(batch)
            at = text * PLACES + places
            flat[at] = np.sqrt(counts.astype(np.float32))
            yield batch, x[: batch.num_rows]
            flat[at] = 0


def _summed(rows: DataFrame, width: int, each: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """(PLACES + 2, width): the sums over all texts of what each() gives for the roots of some. A task gives one table."""
    names = [f"s{i}" for i in range(width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((PLACES + 2, width), np.int64)
        for _, x in _roots(batches):
            total += np.rint(each(x) * UNIT).astype(np.int64)
        yield pa.record_batch([pa.array(np.arange(PLACES + 2)), *map(pa.array, total.T.copy())], ["place", *names])

    tables = rows.select("entries", "many").mapInArrow(run, "place long, " + ", ".join(f"{c} long" for c in names))
    out = np.zeros((PLACES + 2, width))
    for r in tables.groupBy("place").agg(*[F.sum(c).alias(c) for c in names]).collect():
        out[r["place"]] = np.array(r[1:], float) / UNIT
    return out


def _holding(rows: DataFrame) -> np.ndarray:
    """How many texts have a word of each place and, last, how many there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(PLACES + 1, np.int64)
        for batch in batches:
            entries, n = _stretches(batch.column(0), np.uint16)
            total += np.append(np.bincount(entries % PLACES, minlength=PLACES), len(n))
        yield pa.record_batch([pa.array(np.arange(PLACES + 1)), pa.array(total)], ["place", "n"])

    out = np.zeros(PLACES + 1)
    for r in rows.select("entries").mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect():
        out[r["place"]] = r["n"]
    return out


def _unit(x: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    rare = x * rarity
    return rare / np.maximum(np.linalg.norm(rare, axis=1, keepdims=True), np.float32(1e-9))


def _squares(batch: pa.RecordBatch, rarity: np.ndarray) -> np.ndarray:
    """The squared length of each counted text's roots times their words' rarity."""
    text, places, counts = _entries(batch)
    return np.bincount(text, counts * np.square(rarity, dtype=float)[places], batch.num_rows)


def _seed(fit: int, turn: int) -> int:
    return fit * TOPICS * 16 + turn


def _lots(key: np.ndarray, seed: int | np.ndarray) -> np.ndarray:
    """Exponential lots by keys (splitmix64)."""
    z = key.astype(np.uint64) + np.asarray(seed + 1).astype(np.uint64).reshape(-1, 1) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return -np.log(((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(float) / (1 << 53) + 1e-17)


def _drawn(rows: DataFrame, rarity: np.ndarray, begun: dict[int, np.ndarray], turn: int) -> dict[int, tuple[float, np.ndarray]]:
    """Of each fit one more text to begin from, drawn from rows by the squared distance from those drawn before: the text
    whose exponential lot over its weight is least, as that quotient and a unit vector. A fit that has every text already
    gets none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple] = {}
        aims = (rarity * np.vstack(list(begun.values()))).T.copy()
        for batch, x in _roots(batches):
            key, like, at = batch.column(0).to_numpy(), x @ aims, 0
            like /= np.maximum(np.sqrt(_squares(batch, rarity)), 1e-9)[:, None]
            for fit, have in begun.items():
                near = like[:, at : at + len(have)].max(1) if len(have) else np.zeros(len(key))
                at += len(have)
                far = np.where(near < 1 - 1e-6, np.maximum(1 - near, 0) ** 2, 0)
                lot = np.divide(_lots(key, _seed(fit, turn))[0], far, out=np.full(len(far), np.inf), where=far > 0)
                if len(lot) and lot[k := int(lot.argmin())] < np.inf and (fit not in best or (lot[k], key[k]) < best[fit][:2]):
                    best[fit] = (float(lot[k]), int(key[k]), batch.column(1)[k].as_py(), batch.column(2)[k].as_py())
        if best:
            fits, found = list(best), [pa.array(c) for c in zip(*best.values(), strict=True)]
            kinds = (pa.int32(), pa.float64(), pa.int64(), pa.binary(), pa.binary())
            yield pa.record_batch([c.cast(k) for c, k in zip([pa.array(fits), *found], kinds, strict=True)], ["fit", "lot", "key", "entries", "many"])

    least = rows.select("key", "entries", "many").mapInArrow(run, "fit int, lot double, key long, entries binary, many binary")
    out = {}
    for r in least.groupBy("fit").agg(F.min_by(F.struct("entries", "many"), F.struct("lot", "key")).alias("t"), F.min("lot").alias("lot")).collect():
        x = np.zeros((1, PLACES), np.float32)
        places, counts = _read(np.frombuffer(r["t"]["entries"], np.uint16), np.frombuffer(r["t"]["many"], np.int32))
        x[0, places] = np.sqrt(counts)
        out[r["fit"]] = r["lot"], _unit(x, rarity)
    return out


def _begun(rows: DataFrame, rarity: np.ndarray, number: float, topics: int) -> dict[int, np.ndarray]:
    """The texts that each fit begins from, as unit vectors; each is drawn from all rows, of which there are number.

    A weight is 1 at most, so a text's quotient is its lot at least: where the least quotient of the texts with a lot up to
    a bound is within that bound, no other text has a lesser one. So few texts are compared; a draw that they do
    not settle goes over all rows."""
    bound = EARLY / number
    early = keep(rows.filter(F.col("lot") <= bound).dropDuplicates(["key"]).select("key", "entries", "many"))
    begun = {fit: np.zeros((0, PLACES), np.float32) for fit in range(RESTARTS)}
    for turn in range(topics):
        found = _drawn(early, rarity, begun, turn) if turn < TOPICS else {}
        more = {fit: x for fit, (lot, x) in found.items() if lot <= bound}
        if left := {fit: have for fit, have in begun.items() if fit not in more}:
            more |= {fit: x for fit, (_, x) in _drawn(rows, rarity, left, turn).items()}
        if not more and turn:
            break
        begun = {fit: np.vstack([have, more[fit]]) if fit in more else have for fit, have in begun.items()}
    return begun


def _modelled(sums: np.ndarray) -> np.ndarray:
    p, own = sums[:PLACES] + 0.05, sums[PLACES]
    return np.vstack([np.log(p / p.sum(0)), np.log((own + 1e-3) / (own.sum() + 1e-3 * len(own)))])


def _split(sums: np.ndarray, fits: list) -> list[np.ndarray]:
    return np.split(sums, np.cumsum([f.shape[-1] for f in fits])[:-1], axis=1)


def fit_rows(rows: DataFrame, topics: int = TOPICS, rounds: int = FIT_ROUNDS) -> np.ndarray:
    """(PLACES + 1, topics): as fit_topics(), from counted() rows, every one of which takes part in every round.

    A round is one pass; what reaches the driver is a table of PLACES rows. RESTARTS fits share their first rounds' passes."""
    rows = rows.filter("size > 0").select("key", "entries", "many", "lot")
    held = _holding(rows)
    if not held[PLACES]:
        return np.zeros((PLACES + 1, 1))
    rarity = np.log((1 + held[PLACES]) / (1 + held[:PLACES])).astype(np.float32)
    begun = _begun(rows, rarity, held[PLACES], topics)
    # texts of common words alone have no direction: one topic
    seeds = [have if len(have) else np.zeros((1, PLACES), np.float32) for have in begun.values()]

    def first(x: np.ndarray) -> np.ndarray:
        unit, parts = _unit(x, rarity), []
        for seed in seeds:
            own = np.exp(8 * (unit @ seed.T))
            own /= own.sum(1, keepdims=True)
            parts.append(np.vstack([x.T @ own, own.sum(0, keepdims=True), np.zeros((1, own.shape[1]))]))
        return np.hstack(parts)

    turned = [s.T for s in seeds]
    models = [_modelled(s) for s in _split(_summed(rows, sum(m.shape[1] for m in turned), first), turned)]
    like, done = [-np.inf] * len(models), [False] * len(models)
    for n in range(rounds - 1):
        if n == TRIED and len(models) > 1:
            k = int(np.argmax(like))
            models, like, done = [models[k]], [like[k]], [done[k]]
        sent = [m.astype(np.float32) for m in models]

        def step(x: np.ndarray, sent: list = sent) -> np.ndarray:
            z_all, parts, at = x @ np.hstack([m[:-1] for m in sent]), [], 0
            for m in sent:
                z = z_all[:, at : at + m.shape[1]] + m[-1]
                at += m.shape[1]
                most = z.max(1, keepdims=True)
                own = np.exp(z - most)
                total = own.sum(1, keepdims=True)
                tail = np.zeros((1, own.shape[1]))
                tail[0, 0] = (most[:, 0].astype(float) + np.log(total[:, 0])).sum()
                own /= total
                parts.append(np.vstack([x.T @ own, own.sum(0, keepdims=True), tail]))
            return np.hstack(parts)

        sums = _split(_summed(rows, sum(m.shape[1] for m in models), step), models)
        for k, s in enumerate(sums):
            before, like[k] = like[k], float(s[PLACES + 1, 0])
            done[k] = done[k] or like[k] - before < 1e-6 * abs(like[k])
            models[k] = _modelled(s)
        if all(done):
            break
    return models[int(np.argmax(like))]


def learn_topics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", topics: int = TOPICS) -> np.ndarray:
    """Topics of all texts of docs."""
    blank = F.lit(None).cast("string")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), blank.alias("source"), blank.alias("lang"))
    return fit_rows(keep(counted(rows)), topics)


def described(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", model: np.ndarray | None = None) -> DataFrame:
    """doc_id, source, lang, topic, tokens (white-space words, at least one)."""
    rows = keep(counted(docs, doc_id, text, source, lang))
    sent = docs.sparkSession.sparkContext.broadcast(fit_rows(rows) if model is None else model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log_p, log_w = sent.value[:-1], sent.value[-1]
        for batch, x in _roots(batches):
            size = batch.column(3).to_numpy()
            topic = np.where(size > 0, (x @ log_p + log_w).argmax(1), -1)
            yield pa.record_batch([*batch.columns[:3], pa.array(topic.astype(np.int32)), pa.array(np.maximum(size, 1))], ["doc_id", "source", "lang", "topic", "tokens"])

    return rows.select("doc_id", "source", "lang", "size", "entries", "many").mapInArrow(run, "doc_id long, source string, lang string, topic int, tokens long")


def name_of(*columns: str) -> Column:
    """A 64-bit name of values, nulls told from the rest. Tables joined by one long are broadcast as compact maps; a
    map of strings takes a whole page of the driver's memory, however few its rows."""
    return F.xxhash64(*[x for c in columns for x in (F.col(c).isNull(), F.col(c))])


def default_targets(cells: DataFrame, power: float = POWER) -> dict[str, DataFrame]:
    """Of each dimension, a table of value and share, flattened."""
    out = {}
    for d in DIMENSIONS:
        raw = cells.groupBy(d).agg(F.sum("tokens").cast("double").alias("t")).withColumn("share", F.pow("t", F.lit(power)))
        out[d] = raw.select(F.col(d).alias("value"), "share")
    return out


def _aimed(cells: DataFrame, targets: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Targets of the values that there are, as shares that sum to 1."""
    fixed = {}
    for d in DIMENSIONS:
        there = cells.select(F.col(d).alias("there")).distinct()
        t = targets[d].join(there, F.col("value").eqNullSafe(F.col("there"))).select(F.col("value").cast(cells.schema[d].dataType).alias("value"), "share")
        total = t.agg(F.sum("share")).first()[0]
        fixed[d] = t.select("value", (F.col("share") / F.lit(total or 1.0)).alias("share"))
    return fixed


def rake_arrays(tokens: np.ndarray, places: list[np.ndarray], shares: list[np.ndarray], tolerance: float = TOLERANCE) -> tuple[np.ndarray, float, int]:
    """Weights of cells that sum to 1, the largest difference of a marginal from its target, and the rounds.

    places: of each dimension the number of each cell's value; shares: of each dimension the target of each value."""
    w, error, last = tokens.astype(float) / max(tokens.sum(), 1), np.inf, np.inf
    for n in range(MOST_ROUNDS):
        for at, share in zip(places, shares, strict=True):
            now = np.bincount(at, w, len(share))
            w = w * np.divide(share, now, out=np.zeros(len(share)), where=now > 0)[at]
        error = max(float(np.abs(np.bincount(at, w, len(s)) - s).max()) for at, s in zip(places, shares, strict=True))
        if error <= tolerance or (n % 20 == 19 and error > 0.999 * last):
            break
        last = error if n % 20 == 19 else last
    return w, error, n + 1


def _rake_few(cells: DataFrame, fixed: dict[str, DataFrame], tolerance: float) -> tuple[DataFrame, float]:
    rows = cells.select(*DIMENSIONS, "tokens").collect()
    rows = sorted(rows, key=lambda r: tuple((r[d] is None, str(r[d])) for d in DIMENSIONS))
    places, shares = [], []
    for d in DIMENSIONS:
        aim = {r["value"]: r["share"] for r in fixed[d].collect()}
        number = {v: i for i, v in enumerate(dict.fromkeys(r[d] for r in rows))}
        places.append(np.array([number[r[d]] for r in rows], np.int64))
        shares.append(np.array([aim.get(v, 0.0) for v in number]))
    w, error, _ = rake_arrays(np.array([r["tokens"] for r in rows], np.int64), places, shares, tolerance) if rows else (np.zeros(0), 0.0, 0)
    table = pa.table({**{d: pa.array([r[d] for r in rows], pa.int32() if d == "topic" else pa.string()) for d in DIMENSIONS}, "tokens": pa.array([r["tokens"] for r in rows], pa.int64()), "raked": pa.array(w, pa.float64())})
    return cells.sparkSession.createDataFrame(table), error


def _rake_many(cells: DataFrame, fixed: dict[str, DataFrame], tolerance: float) -> tuple[DataFrame, float]:
    """The same by aggregates and joins; the error is looked at every fourth round, after which the lineage is cut."""
    fixed = {d: keep(t) for d, t in fixed.items()}
    total = cells.agg(F.sum("tokens")).first()[0] or 1
    cells, last = keep(cells.withColumn("raked", F.col("tokens") / F.lit(float(total)))), np.inf
    by_value = lambda d: cells.groupBy(name_of(d).alias("value")).agg(F.sum("raked").alias("now"))
    aim = {d: t.select(name_of("value").alias("value"), "share") for d, t in fixed.items()}
    for n in range(MOST_ROUNDS):
        for d in DIMENSIONS:
            # a table, for what is joined below would else hold its own plan twice
            scale = keep(by_value(d).join(aim[d], "value", "left").select("value", F.when(F.col("now") > 0, F.coalesce("share", F.lit(0.0)) / F.col("now")).otherwise(0.0).alias("by")))
            cells = cells.join(scale, name_of(d) == F.col("value"), "left").select(*DIMENSIONS, "tokens", (F.col("raked") * F.col("by")).alias("raked"))
        if n % 4 == 3:
            cells = keep(cells)
            error = max(by_value(d).join(aim[d], "value", "full").agg(F.max(F.abs(F.coalesce("share", F.lit(0.0)) - F.coalesce("now", F.lit(0.0))))).first()[0] or 0.0 for d in DIMENSIONS)
            if error <= tolerance or error > 0.999 * last:
                break
            last = error
    return cells, error


def rake(cells: DataFrame, targets: dict[str, DataFrame], tolerance: float = TOLERANCE) -> tuple[DataFrame, float]:
    """cells with `raked`, weights that sum to 1, and the largest difference of a marginal from its target."""
    few = cells.count() <= FEW_CELLS
    return (_rake_few if few else _rake_many)(cells, _aimed(cells, targets), tolerance)


def report(raked: DataFrame, targets: dict[str, DataFrame]) -> DataFrame:
    """dimension, value, target, reached: shares of tokens."""
    out = None
    for d, t in _aimed(raked, targets).items():
        now = raked.groupBy(F.col(d).alias("there")).agg(F.sum("raked").alias("reached"))
        rows = now.join(t, F.col("value").eqNullSafe(F.col("there")), "left").select(F.lit(d).alias("dimension"), F.col("there").cast("string").alias("value"), F.coalesce("share", F.lit(0.0)).alias("target"), "reached")
        out = rows if out is None else out.unionByName(rows)
    return out


def probabilities(cells: DataFrame, share: float = SHARE) -> DataFrame:
    """cells with `prob`: raked tokens over tokens, scaled so that share of all tokens is expected, at most 1.

    Each step takes the cells whole that reach 1 and raises the scale of the others; it ends when no cell is added. A
    cell that is whole stays so, for the scale only rises, and steps that add none end it."""
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    ratio = F.col("raked") / F.col("tokens")
    scale, want = 0.0, share * total
    while True:
        full = ratio * F.lit(scale) >= 1
        got = cells.agg(F.sum(F.when(full, F.col("tokens")).otherwise(0)), F.sum(F.when(full, 0.0).otherwise(F.col("raked")))).first()
        if not got[1]:
            break
        now = max(0.0, want - (got[0] or 0)) / got[1]
        if now <= scale * (1 + 1e-9):
            break
        scale = now
    return cells.withColumn("prob", F.least(F.lit(1.0), ratio * F.lit(scale)))


def draw(doc_id: str | Column = "doc_id", seed: int = 17) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.col(doc_id) if isinstance(doc_id, str) else doc_id), F.lit(1 << 40)) / float(1 << 40)


def mix(docs: DataFrame, targets: dict[str, DataFrame] | None = None, share: float = SHARE, **columns: str) -> DataFrame:
    """One row per row of docs: doc_id, source, lang, topic, tokens, prob, sampled, target_error.

    target_error is the largest difference of a raked marginal from its target. Above TOLERANCE the targets contradict each
    other (or raking has stopped getting nearer), which is also warned of."""
    rows = keep(described(docs, **columns))
    cells = keep(rows.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")))
    raked, error = rake(cells, targets or default_targets(cells))
    if error > TOLERANCE:
        warnings.warn(f"targets are missed by up to {error:.3g} of all tokens", stacklevel=2)
    fitted = keep(probabilities(raked, share).select(name_of(*DIMENSIONS).alias("cell"), "prob"))
    return rows.join(fitted, name_of(*DIMENSIONS) == F.col("cell"), "left").select("doc_id", *DIMENSIONS, "tokens", "prob", (draw() < F.col("prob")).alias("sampled"), F.lit(error).alias("target_error"))
