"""Exact deduplication by content-defined chunk recipes, in DataFrame functions only.

A normalised text (white space of 20 and 09-0D deleted) is cut where its own characters say so, never at fixed
offsets. A chunk is named by a 64-bit hash and the names are verified: names that stand for more than one (length,
SHA-256) are found by a pre-aggregated count over all chunks, and recipes holding one carry their text's SHA-256 as
a tie breaker. Whether a recipe is doubtful is a property of the recipe, not of a row or its id. Texts are then equal exactly
when their ordered lists of names are, so the lists (8 bytes for some hundred characters) are what is shuffled, and the
texts are read once and never move.

Cases: null text is the empty text; the empty recipe is a group like any other; equal length falls to the smaller
id; repeated ids give a row each, whatever their texts; a row without an id is in its group, but another of its length
stays; an empty table gives no rows. Columns other than id and text are not read, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import WHITE, discard, keep

#: A cut follows three characters of this class, about once in 400 characters of prose. Letters of basic Latin are named, in
#: both cases, for they are far from equally frequent; elsewhere the code point decides: one in eight of small alphabets,
#: one in eight blocks of large ones. MAX_CHUNK bounds what is left, such as one letter a thousand times.
LATIN = "dlmuDLMU05éöÉÖ"
#: First and last code point, and width of a block.
BLOCKS = [(0x100, 0xFFF, 1), (0x1000, 0x33FF, 4), (0x3400, 0xD7FF, 64), (0xE000, 0xFFFF, 64), (0x10000, 0x17FFF, 8), (0x18000, 0x1EFFF, 8), (0x1F000, 0x1FFFF, 64), (0x20000, 0x3FFFF, 512), (0x40000, 0x10FFFF, 4096)]


def _every(first: int, last: int, width: int) -> str:
    """Of each eight blocks of so many code points the fourth."""
    starts = range(first - first % (8 * width) + 3 * width, last, 8 * width)
    return "".join(f"\\x{{{a:X}}}-\\x{{{a + width - 1:X}}}" for a in starts)


CUT_CLASS = f"[{LATIN}" + "".join(f"[\\x{{{a:X}}}-\\x{{{b:X}}}&&[{_every(a, b, width)}]]" for a, b, width in BLOCKS) + "]"
MAX_CHUNK = 2048
CHUNKS = f"(?s).{{1,{MAX_CHUNK}}}?{CUT_CLASS}{{3}}|.{{1,{MAX_CHUNK}}}"


def normalised(text):
    return F.translate(F.coalesce(text, F.lit("")), WHITE, "")


def recipes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", digest=None) -> DataFrame:
    """doc_id, n_chars, text_sha256, chunks: array of (h, n, d), the name, length and digest of each chunk in order."""
    digest = digest or F.xxhash64
    d = docs.select(F.col(doc_id).alias("doc_id"), F.length(F.coalesce(F.col(text), F.lit(""))).alias("n_chars"), normalised(F.col(text)).alias("norm"))
    d = d.select("doc_id", "n_chars", F.sha2("norm", 256).alias("text_sha256"), F.regexp_extract_all("norm", F.lit(CHUNKS), F.lit(0)).alias("c"))
    chunk = lambda c: F.struct(digest(c).alias("h"), F.length(c).alias("n"), F.unhex(F.sha2(c, 256)).alias("d"))
    return d.select("doc_id", "n_chars", "text_sha256", F.transform("c", chunk).alias("chunks"))


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", digest=None) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    digest names chunks (a Column to bigint Column function); any choice gives right results."""
    kept = keep(recipes(docs, doc_id, text, digest).withColumn("recipe", F.col("chunks.h")).withColumn("rid", F.xxhash64("recipe")))
    each = kept.select("rid", F.explode("chunks").alias("c")).select("rid", "c.*")
    verified = each.groupBy("h", "n", "d").agg(F.lit(1).alias("one")).groupBy("h").agg(F.count("*").alias("contents"))
    # tables, so that the joins can split a chunk or a recipe that many documents share
    bad = keep(verified.filter("contents > 1").select("h"), rows=F.count(F.lit(1)))
    columns = ["doc_id", "n_chars", "text_sha256", "recipe"]
    named = kept.select(*columns, F.lit("").alias("tie"))
    if bad.seen["rows"]:
        doubtful = keep(each.select("rid", "h").join(bad, "h", "left_semi").select("rid").distinct().withColumn("doubt", F.lit(True)))
        named = keep(kept.join(doubtful, "rid", "left").select(*columns, F.when(F.col("doubt"), F.col("text_sha256")).otherwise("").alias("tie")))
        discard(kept, doubtful)
    discard(bad)
    # the complement turns the order of ids round, the least one too, which has no negative
    best = F.max(F.struct(F.col("n_chars"), F.bitwise_not("doc_id").alias("turned")))
    groups = keep(named.groupBy("recipe", "tie").agg(F.count("*").alias("group_size"), best.alias("best")).select("recipe", "tie", "group_size", F.bitwise_not("best.turned").alias("keep_id")))
    return named.join(groups, ["recipe", "tie"]).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents)
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY t ORDER BY n DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY t ORDER BY n DESC, doc_id) AS kept,
       sha256(t) AS text_sha256
FROM d
"""
