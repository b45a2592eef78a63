"""A bounded, repeatable sample of labelled rows, for fitting classifiers on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def draw(counts: dict, label: str, per_class: int, key: str = "doc_id"):
    """A predicate that holds for about per_class rows of each label (all of a rarer one), by a hash of the key."""
    rate = F.lit(0.0)
    for value, n in counts.items():
        rate = F.when(F.col(label) == F.lit(value), F.lit(min(1.0, per_class / n))).otherwise(rate)
    return F.col(label).isNotNull() & (F.pmod(F.xxhash64(F.col(key)), F.lit(1 << 30)) / float(1 << 30) < rate)


def count_labels(rows: DataFrame, label: str) -> dict:
    return {r[label]: r["n"] for r in rows.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n")).collect()}


def labelled_sample(rows: DataFrame, label: str, per_class: int, columns: list[str], key: str = "doc_id") -> list:
    """key, label and columns of about per_class rows of each label, in the order of their keys.

    The first pass counts labels without reading texts; the second keeps rows under a hash threshold. What reaches the
    driver is bounded by per_class and the number of labels."""
    counts = count_labels(rows, label)
    got = rows.filter(draw(counts, label, per_class, key)).select(key, label, *columns).limit(2 * per_class * max(1, len(counts))).collect()
    return sorted(got, key=lambda r: str(r[key]))


def joined_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, doc_id: str, text: str) -> tuple[list, dict]:
    """(doc_id, label, text) of about per_class documents of each label, and all label counts.

    The sample is drawn from labels alone; its ids, bounded as above, are broadcast, so no text is shuffled."""
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).alias("label"))
    counts = count_labels(known, "label")
    ids = known.filter(draw(counts, "label", per_class)).limit(2 * per_class * max(1, len(counts)))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(ids), "doc_id")
    return sorted(rows.collect(), key=lambda r: str(r["doc_id"])), counts
