"""One query for each operator over the relational test tables, and its DuckDB counterpart where SQL has one."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from rasterloom.functions import scalar as fn
from rasterloom.operators import huffman, joins, kmeans, lz, metrics, pruned, scan, sequence
from rasterloom.plans import codecs
from rasterloom.plans.measure import measure, measured
from rasterloom.sources import reports
from rasterloom.sources.shared import new_folder, written
from rasterloom.sources.tables import doc_bytes, images, pixels, pixels_flat, seq_events, table
from rasterloom.streaming import stateful

#: Texts whose results a coder's task holds before it gives them.
TEXTS = 256
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
RGB = list(fn.RGB)

_ORDER = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount, l_tax"
_RASTER = (
    "SELECT img_id, pos, (pos % 32)::INT AS x, (pos // 32)::INT AS y, r, g, b FROM (SELECT *, count(*) "
    "OVER (PARTITION BY img_id) AS n FROM {0}) WHERE pos < n - n % 32"
)
#: Named pieces of the SQL side: rasters, their sizes, sequences, bytes.
PARTS = {
    "PX": (
        f"px0 AS (SELECT l_orderkey // 2048 AS img_id, row_number() OVER (PARTITION BY l_orderkey // 2048 "
        f"ORDER BY {_ORDER}) - 1 AS pos, floor(l_quantity * 5)::INT AS r, floor(l_discount * 1000 + 0.5)::INT "
        f"AS g, floor(l_tax * 1000 + 0.5)::INT AS b FROM lineitem), px AS ({_RASTER.format('px0')})"
    ),
    "FLAT": "fl0 AS (SELECT l_orderkey // 2048 AS img_id, row_number() OVER (PARTITION BY l_orderkey // 2048 ORDER BY l_returnflag, l_linestatus, "
    + _ORDER
    + (
        ") - 1 AS pos, CASE l_returnflag || l_linestatus WHEN 'AF' THEN 200 WHEN 'NF' THEN 10 WHEN 'NO' THEN "
        "10 WHEN 'RF' THEN 90 ELSE 128 END AS r, CASE l_returnflag || l_linestatus WHEN 'AF' THEN 10 WHEN "
        "'NF' THEN 200 WHEN 'NO' THEN 10 WHEN 'RF' THEN 90 ELSE 128 END AS g, CASE l_returnflag || l_linestatus "
        "WHEN 'AF' THEN 10 WHEN 'NF' THEN 10 WHEN 'NO' THEN 200 WHEN 'RF' THEN 0 ELSE 128 END AS b FROM lineitem), "
        "flat AS ("
    )
    + _RASTER.format("fl0")
    + ")",
    "DIMS": "dims AS (SELECT img_id, max(x) + 1 AS w, max(y) + 1 AS h, count(*) AS n_pixels FROM px GROUP BY 1)",
    "EV": (
        "ev AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, "
        "event_type, floor(value * 100 + 0.5)::BIGINT AS value_cents FROM events)"
    ),
    "RUNS": (
        "rn1 AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR r <> lag(r) OVER w OR g <> lag(g) OVER w "
        "OR b <> lag(b) OVER w THEN 1 ELSE 0 END AS nw FROM flat WINDOW w AS (PARTITION BY img_id ORDER BY "
        "pos)), rn2 AS (SELECT *, sum(nw) OVER (PARTITION BY img_id ORDER BY pos) AS run FROM rn1), rn3 AS "
        "(SELECT *, (row_number() OVER (PARTITION BY img_id, run ORDER BY pos) - 1) // 255 AS part FROM rn2), "
        "runs AS (SELECT img_id, row_number() OVER (PARTITION BY img_id ORDER BY run, part) - 1 AS seq, count(*)::INT "
        "AS cnt, any_value(r) AS r, any_value(g) AS g, any_value(b) AS b FROM rn3 GROUP BY img_id, run, part)"
    ),
    "HIST": "hist AS (SELECT img_id, r, g, b, count(*) AS cnt FROM px GROUP BY ALL)",
    "CENT": (
        "ini AS (SELECT *, least((n - 1 - place) // (n // 8), 7)::INT AS cid FROM (SELECT *, count(*) OVER "
        "(PARTITION BY img_id) AS n, row_number() OVER (PARTITION BY img_id ORDER BY pos) - 1 AS place FROM "
        "px)), cent AS (SELECT img_id, cid, arg_min(x, pos) AS x, arg_min(y, pos) AS y, arg_min(r, pos) AS "
        "r, arg_min(g, pos) AS g, arg_min(b, pos) AS b FROM ini GROUP BY ALL)"
    ),
    "HILB": (
        "cells AS (SELECT img_id, pos, x, y, x AS u, y AS v, (side // 2)::BIGINT AS s, 0::BIGINT AS d FROM "
        "sided UNION ALL SELECT img_id, pos, x, y, CASE WHEN (v & s) = 0 THEN CASE WHEN (u & s) > 0 THEN "
        "s - 1 - (v & (s - 1)) ELSE v & (s - 1) END ELSE u & (s - 1) END, CASE WHEN (v & s) = 0 THEN CASE "
        "WHEN (u & s) > 0 THEN s - 1 - (u & (s - 1)) ELSE u & (s - 1) END ELSE v & (s - 1) END, s // 2, d "
        "+ s * s * xor(CASE WHEN (u & s) > 0 THEN 3 ELSE 0 END, CASE WHEN (v & s) > 0 THEN 1 ELSE 0 END) "
        "FROM cells WHERE s > 0)"
    ),
    "BYTES": (
        "byts AS (SELECT doc_id, k - 1 AS pos, ('0x' || h)::INT AS byte FROM (SELECT doc_id, unnest(l) AS "
        "h, generate_subscripts(l, 1) AS k FROM (SELECT doc_id, regexp_extract_all(hex(encode(text)), '..') "
        "AS l FROM documents WHERE text IS NOT NULL)))"
    ),
}


def query(name: str, sql: str | None = None):
    """Registers a query; {PX} and the like in its SQL are the named parts."""

    def add(f):
        QUERIES[name] = f
        if sql:
            text = sql
            for k, v in PARTS.items():
                text = text.replace(f"{{{k}}}", v)
            ORACLE_SQL[name] = text
        return f

    return add


def colours(px: DataFrame) -> DataFrame:
    return px.groupBy("img_id", *RGB).agg(F.count("*").alias("cnt"))


# flagship


@query("flat_rle_summary", (
    "WITH {FLAT}, {RUNS} SELECT img_id, count(*) AS n_runs, 8 + 12 * count(*) AS size, sum(cnt)::BIGINT "
    "AS n_pixels, (8 + 12 * count(*)) / (3.0 * sum(cnt)) AS ratio FROM runs GROUP BY 1"
))
def flat_rle_summary(spark, sf):
    rle = sequence.runs(pixels_flat(spark, sf), ["img_id"], "pos")
    size = F.lit(8) + 12 * F.count("*")
    return rle.groupBy("img_id").agg(F.count("*").alias("n_runs"), size.alias("size"), F.sum("cnt").alias("n_pixels"), (size / (F.lit(3.0) * F.sum("cnt"))).alias("ratio"))


# sources and scans


@query("src_pixels", "WITH {PX} SELECT * FROM px")
def src_pixels(spark, sf):
    return pixels(spark, sf)


@query("src_pixels_flat", "WITH {FLAT} SELECT * FROM flat")
def src_pixels_flat(spark, sf):
    return pixels_flat(spark, sf)


@query("src_seq_events", "WITH {EV} SELECT * FROM ev")
def src_seq_events(spark, sf):
    return seq_events(spark, sf)


@query("src_doc_bytes", "SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n_bytes, md5(coalesce(text, '')) AS md5 FROM documents")
def src_doc_bytes(spark, sf):
    return doc_bytes(spark, sf).select("doc_id", F.octet_length("data").cast("long").alias("n_bytes"), F.md5("data").alias("md5"))


@query("src_hilbert_rect", (
    "WITH {PX} SELECT img_id, count(*) AS n, 0::BIGINT AS lo, count(*) - 1 AS hi, count(*) AS n_places, "
    "0::BIGINT AS start_x, 0::BIGINT AS start_y FROM px GROUP BY 1"
))
def src_hilbert_rect(spark, sf):
    """The scan as facts that any rectangle must meet: all places from 0 to n - 1, from the origin on."""
    px = pixels(spark, sf)
    s = scan.hilbert_rect(px, images(px))
    first = lambda c: F.min_by(c, "hidx").cast("long")
    return s.groupBy("img_id").agg(F.count("*").alias("n"), F.min("hidx").alias("lo"), F.max("hidx").alias("hi"), F.countDistinct("hidx").alias("n_places"), first("x").alias("start_x"), first("y").alias("start_y"))


@query("src_hilbert_small", (
    "WITH RECURSIVE {PX}, {DIMS}, sided AS (SELECT px.*, side FROM px JOIN (SELECT img_id, least(2 ** "
    "(ceil(log2(w))::INT), 2 ** (ceil(log2(h))::INT))::BIGINT // 2 AS side FROM dims) USING (img_id) "
    "WHERE x < side AND y < side), {HILB} SELECT img_id, pos, x, y, d AS hidx FROM cells WHERE s = 0"
))
def src_hilbert_small(spark, sf):
    px = pixels(spark, sf)
    return scan.hilbert_small(px, images(px)).select("img_id", "pos", "x", "y", "hidx")


@query("src_hilbert_large", (
    "WITH RECURSIVE {PX}, {DIMS}, sided AS (SELECT px.*, side FROM px JOIN (SELECT img_id, greatest(2 "
    "** (ceil(log2(w))::INT), 2 ** (ceil(log2(h))::INT))::BIGINT AS side FROM dims) USING (img_id)), "
    "{HILB} SELECT img_id, pos, x, y, d AS hidx FROM cells WHERE s = 0"
))
def src_hilbert_large(spark, sf):
    px = pixels(spark, sf)
    return scan.hilbert_large(px, images(px)).select("img_id", "pos", "x", "y", "hidx")


def _reports(spark, sf):
    """Results of codecs whose sizes have a closed form, as report rows."""
    flat, noise = pixels_flat(spark, sf), pixels(spark, sf)
    dims = written(images(noise), "sizes")
    rle = sequence.runs(flat, ["img_id"], "pos").groupBy("img_id").agg((F.lit(8) + 12 * F.count("*")).alias("compressed_size"))
    raw = dims.select("img_id", (F.lit(8) + 11 * F.col("n_pixels")).alias("compressed_size"))
    vor = dims.select("img_id", F.lit(16 + 19 * 8).cast("long").alias("compressed_size"))
    named = [d.withColumn("codec", F.lit(n)).withColumn("error", F.lit(e).cast("double")) for d, n, e in ((rle, "hilbert-rle", 0.0), (raw, "plain_11", None), (vor, "voronoi_8", 2.5))]
    rows = named[0].unionByName(named[1]).unionByName(named[2]).join(dims, "img_id")
    return rows.select("codec", F.col("img_id").cast("string").alias("name"), "compressed_size", metrics.ratio_ref(F.col("compressed_size"), F.col("w"), F.col("h")).alias("compression_ratio"), "error")


_REPORTS = (
    "WITH {PX}, {FLAT}, {RUNS}, {DIMS}, rep0 AS (SELECT 'hilbert-rle' AS codec, img_id, 8 + 12 * count(*) "
    "AS compressed_size, 0.0 AS error FROM runs GROUP BY img_id UNION ALL SELECT 'plain_11', img_id, "
    "8 + 11 * n_pixels, NULL FROM dims UNION ALL SELECT 'voronoi_8', img_id, 168, 2.5 FROM dims), rep "
    "AS (SELECT codec, img_id::VARCHAR AS name, compressed_size, compressed_size::DOUBLE / (w * h * 24) "
    "* 100 AS compression_ratio, error::DOUBLE AS error FROM rep0 JOIN dims USING (img_id)) "
)


# projections and filters


@query("prj_signed", "WITH {PX} SELECT img_id, pos, r::SMALLINT AS sr, g::SMALLINT AS sg, b::SMALLINT AS sb FROM px")
def prj_signed(spark, sf):
    return pixels(spark, sf).select("img_id", "pos", *[fn.signed(F.col(c)).alias(f"s{c}") for c in RGB])


@query("prj_unsigned", "WITH {PX} SELECT img_id, pos, r, g, b FROM px")
def prj_unsigned(spark, sf):
    return pixels(spark, sf).select("img_id", "pos", *[fn.unsigned(fn.signed(F.col(c))).alias(c) for c in RGB])


@query("prj_as_f64", "WITH {PX} SELECT img_id, pos, r::DOUBLE AS fr, g::DOUBLE AS fg, b::DOUBLE AS fb FROM px")
def prj_as_f64(spark, sf):
    return pixels(spark, sf).select("img_id", "pos", *[F.col(c).cast("double").alias(f"f{c}") for c in RGB])


@query("flt_in_bounds", "WITH {PX}, {DIMS} SELECT img_id, x, y FROM px JOIN dims USING (img_id) WHERE x < least(w, h) AND y < least(w, h)")
def flt_in_bounds(spark, sf):
    px = pixels(spark, sf)
    return px.join(images(px), "img_id").filter("x < least(w, h) AND y < least(w, h)").select("img_id", "x", "y")


@query("flt_lossless", _REPORTS + "SELECT codec, name FROM rep WHERE codec IN (SELECT codec FROM rep GROUP BY 1 HAVING coalesce(avg(error), 0) = 0)")
def flt_lossless(spark, sf):
    return metrics.lossless_only(_reports(spark, sf), "codec").select("codec", "name")


@query("flt_active_cluster", "WITH {PX}, {CENT} SELECT img_id, cid, count(*) AS n FROM ini GROUP BY ALL HAVING count(*) > 0")
def flt_active_cluster(spark, sf):
    return kmeans.init_assignment(pixels(spark, sf), 8).groupBy("img_id", "cid").agg(F.count("*").alias("n")).filter("n > 0")


@query("flt_slice", "WITH {PX}, {DIMS} SELECT img_id, pos, r FROM px JOIN dims USING (img_id) WHERE pos >= n_pixels // 4 AND pos < n_pixels // 2")
def flt_slice(spark, sf):
    px = pixels(spark, sf)
    return px.join(images(px), "img_id").filter("pos >= n_pixels div 4 AND pos < n_pixels div 2").select("img_id", "pos", "r")


# aggregates


@query("ag_count_freqs", "WITH {HIST0} SELECT * FROM hist".replace("{HIST0}", "{PX}, {HIST}"))
def ag_count_freqs(spark, sf):
    return colours(pixels(spark, sf))


@query("ag_mse", (
    "WITH {PX}, {FLAT} SELECT img_id, sum((px.r - flat.r) ** 2 + (px.g - flat.g) ** 2 + (px.b - flat.b) "
    "** 2) / count(*) AS error, true AS size_ok FROM px JOIN flat USING (img_id, pos) GROUP BY 1"
))
def ag_mse(spark, sf):
    return metrics.mse(pixels(spark, sf), pixels_flat(spark, sf))


@query("ag_wmean_color", (
    "WITH {PX}, {HIST} SELECT img_id, (sum(r * cnt) // sum(cnt))::INT AS r, (sum(g * cnt) // sum(cnt))::INT "
    "AS g, (sum(b * cnt) // sum(cnt))::INT AS b FROM hist GROUP BY 1"
))
def ag_wmean_color(spark, sf):
    return colours(pixels(spark, sf)).groupBy("img_id").agg(*[kmeans.weighted_mean(c).alias(c) for c in RGB])


@query("ag_mean_5d", (
    "WITH {PX} SELECT img_id, (sum(x) // count(*))::INT AS x, (sum(y) // count(*))::INT AS y, (sum(r) "
    "// count(*))::INT AS r, (sum(g) // count(*))::INT AS g, (sum(b) // count(*))::INT AS b FROM px GROUP "
    "BY 1"
))
def ag_mean_5d(spark, sf):
    return pixels(spark, sf).withColumn("cnt", F.lit(1)).groupBy("img_id").agg(*[kmeans.weighted_mean(c).alias(c) for c in kmeans.PLACE])


@query("ag_cluster_counts", (
    "WITH {PX}, {CENT} SELECT img_id, sum(n)::BIGINT AS points, count(*) AS active, count(*) >= least(sum(n), "
    "7) AS enough FROM (SELECT img_id, cid, count(*) AS n FROM ini GROUP BY ALL) GROUP BY 1"
))
def ag_cluster_counts(spark, sf):
    return kmeans.cluster_counts(kmeans.init_assignment(pixels(spark, sf), 8), 8)


@query("ag_codec_mean", _REPORTS + "SELECT codec, avg(compression_ratio) AS ratio, coalesce(avg(error), 0) AS error FROM rep GROUP BY 1")
def ag_codec_mean(spark, sf):
    return _reports(spark, sf).groupBy("codec").agg(F.avg("compression_ratio").alias("ratio"), F.coalesce(F.avg("error"), F.lit(0.0)).alias("error"))


@query("ag_codec_group", _REPORTS + "SELECT split_part(codec, '_', 1) AS family, count(DISTINCT codec) AS files, count(*) AS n FROM rep GROUP BY 1")
def ag_codec_group(spark, sf):
    return _reports(spark, sf).groupBy(reports.codec_group(F.col("codec")).alias("family")).agg(F.countDistinct("codec").alias("files"), F.count("*").alias("n"))


@query("ag_boxplot", _REPORTS + (
    ", box AS (SELECT codec, quantile_cont(compression_ratio, 0.25) AS q1, quantile_cont(compression_ratio, "
    "0.5) AS median, quantile_cont(compression_ratio, 0.75) AS q3, avg(compression_ratio) AS mean FROM "
    "rep GROUP BY 1) SELECT box.*, min(compression_ratio) AS whisker_lo, max(compression_ratio) AS whisker_hi "
    "FROM box JOIN rep USING (codec) WHERE compression_ratio BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 "
    "* (q3 - q1) GROUP BY ALL"
))
def ag_boxplot(spark, sf):
    return metrics.boxplot(_reports(spark, sf), ["codec"], "compression_ratio")


@query("ag_dims_hist", "WITH {PX}, {DIMS} SELECT w || 'x' || h AS dims, count(*) AS cnt FROM dims GROUP BY 1")
def ag_dims_hist(spark, sf):
    return metrics.dims_histogram(images(pixels(spark, sf)))


@query("ag_ncolors", "WITH {PX}, {HIST} SELECT img_id, count(*) AS ncolors FROM hist GROUP BY 1")
def ag_ncolors(spark, sf):
    return metrics.n_colours(pixels(spark, sf))


@query("ag_subpixel_hist", "WITH {PX} SELECT img_id, level, count(*) AS cnt FROM (SELECT img_id, unnest([r, g, b]) AS level FROM px) GROUP BY ALL")
def ag_subpixel_hist(spark, sf):
    return metrics.subpixel_histogram(pixels(spark, sf))


@query("ag_diff_hist", (
    "WITH {PX} SELECT img_id, diff, count(*) AS cnt FROM (SELECT img_id, r - lag(r) OVER (PARTITION BY "
    "img_id ORDER BY pos) AS diff FROM px) WHERE diff IS NOT NULL GROUP BY ALL"
))
def ag_diff_hist(spark, sf):
    return sequence.series_diff(pixels(spark, sf), ["img_id"], "pos", "r").groupBy("img_id", "diff").agg(F.count("*").alias("cnt"))


# windows and sequences


@query("wn_positions", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events")
def wn_positions(spark, sf):
    return sequence.positions(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "pos")


_DELTA = (
    "dl AS (SELECT img_id, pos, r - coalesce(lag(r) OVER w, 0) AS dr, g - coalesce(lag(g) OVER w, 0) "
    "AS dg, b - coalesce(lag(b) OVER w, 0) AS db FROM px WINDOW w AS (PARTITION BY img_id ORDER BY pos))"
)


@query("wn_delta", "WITH {PX}, " + _DELTA + " SELECT * FROM dl")
def wn_delta(spark, sf):
    return sequence.delta(pixels(spark, sf), ["img_id"], "pos")


@query("wn_undelta", "WITH {PX} SELECT img_id, pos, r, g, b FROM px")
def wn_undelta(spark, sf):
    return sequence.undelta(sequence.delta(pixels(spark, sf), ["img_id"], "pos"), ["img_id"], "pos")


@query("wn_rle_framework", (
    "WITH {EV}, a AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER "
    "BY pos) THEN 0 ELSE 1 END AS nw FROM ev), b AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER "
    "BY pos) AS run FROM a) SELECT user_id, run::BIGINT - 1 AS seq, count(*)::INT AS cnt, any_value(event_type) "
    "AS event_type FROM b GROUP BY user_id, run"
))
def wn_rle_framework(spark, sf):
    """Runs of any column, here of each user's event types, without a cap."""
    return sequence.runs(seq_events(spark, sf), ["user_id"], "pos", ("event_type",), None)


@query("wn_rle_exact", "WITH {FLAT}, {RUNS} SELECT * FROM runs")
def wn_rle_exact(spark, sf):
    return sequence.runs(pixels_flat(spark, sf), ["img_id"], "pos")


@query("wn_rle_decode", "WITH {FLAT} SELECT img_id, pos, r, g, b FROM flat")
def wn_rle_decode(spark, sf):
    return sequence.expand_runs(sequence.runs(pixels_flat(spark, sf), ["img_id"], "pos"), ["img_id"])


@query("wn_series_diff", (
    "WITH {EV} SELECT user_id, pos, diff FROM (SELECT user_id, pos, value_cents - lag(value_cents) OVER "
    "(PARTITION BY user_id ORDER BY pos) AS diff FROM ev) WHERE diff IS NOT NULL"
))
def wn_series_diff(spark, sf):
    return sequence.series_diff(seq_events(spark, sf), ["user_id"], "pos", "value_cents")


# joins


def _cents(spark, sf, k=8):
    px = pixels(spark, sf)
    assigned = kmeans.init_assignment(px, k)
    return px, assigned, kmeans.init_centroids(assigned, kmeans.PLACE)


_NEAR = (
    "near AS (SELECT c.img_id, c.r, c.g, c.b, arg_min({'nr': k.r, 'ng': k.g, 'nb': k.b}, ((c.r - k.r) "
    "** 2 + (c.g - k.g) ** 2 + (c.b - k.b) ** 2)::BIGINT * 8 + cid) AS m FROM hist c JOIN cent k USING "
    "(img_id) GROUP BY ALL)"
)


def _palette(spark, sf):
    px, _, cents = _cents(spark, sf)
    cols = colours(px).withColumn("pos", (F.col("r") * 65536 + F.col("g") * 256 + F.col("b")).cast("long"))
    found = joins.nearest(cols, cents, RGB)
    to = cents.select("img_id", "cid", *[F.col(c).alias(f"n{c}") for c in RGB])
    return px, cols.join(found, ["img_id", "pos"]).join(to, ["img_id", "cid"]).select("img_id", *RGB, "nr", "ng", "nb")


@query("jn_lookup_palette", "WITH {PX}, {HIST}, {CENT}, " + _NEAR + " SELECT px.img_id, pos, x, y, m.nr AS r, m.ng AS g, m.nb AS b FROM px JOIN near USING (img_id, r, g, b)")
def jn_lookup_palette(spark, sf):
    return joins.recolour(*_palette(spark, sf))


@query("prj_recolor", "WITH {PX}, {HIST}, {CENT}, " + _NEAR + " SELECT px.img_id, m.nr AS r, m.ng AS g, m.nb AS b, count(*) AS cnt FROM px JOIN near USING (img_id, r, g, b) GROUP BY ALL")
def prj_recolor(spark, sf):
    return colours(joins.recolour(*_palette(spark, sf)))


@query("jn_positional", "WITH {PX}, {FLAT} SELECT img_id, pos, px.r AS a, flat.r AS b FROM px JOIN flat USING (img_id, pos)")
def jn_positional(spark, sf):
    a, b = pixels(spark, sf), pixels_flat(spark, sf)
    return joins.positional(a.select("img_id", "pos", F.col("r").alias("a")), b.select("img_id", "pos", F.col("r").alias("b")), ["img_id", "pos"])


@query("jn_nearest_xy", (
    "WITH {PX}, {CENT} SELECT px.img_id, px.pos, arg_min(cid, ((px.x - cent.x) ** 2 + (px.y - cent.y) "
    "** 2)::BIGINT * 8 + cid) AS cid, min((px.x - cent.x) ** 2 + (px.y - cent.y) ** 2)::BIGINT AS d2 "
    "FROM px JOIN cent USING (img_id) GROUP BY ALL"
))
def jn_nearest_xy(spark, sf):
    px, _, cents = _cents(spark, sf)
    return joins.nearest_numpy(px, cents, ["x", "y"])


_ASSIGN = (
    "SELECT ini.img_id, ini.pos, arg_min(cent.cid, ((ini.r - cent.r) ** 2 + (ini.g - cent.g) ** 2 + (ini.b "
    "- cent.b) ** 2)::BIGINT * 100 + CASE WHEN cent.cid = ini.cid THEN 0 ELSE 1 END * 10 + cent.cid) "
    "AS cid, min((ini.r - cent.r) ** 2 + (ini.g - cent.g) ** 2 + (ini.b - cent.b) ** 2)::BIGINT AS d2 "
    "FROM ini JOIN cent USING (img_id) GROUP BY ALL"
)


@query("jn_nearest_feature", "WITH {PX}, {CENT} " + _ASSIGN)
def jn_nearest_feature(spark, sf):
    _, assigned, cents = _cents(spark, sf)
    return joins.nearest(assigned.withColumnRenamed("cid", "own"), cents, RGB, current="own")


@query("jn_nearest_numpy", "WITH {PX}, {CENT} " + _ASSIGN)
def jn_nearest_numpy(spark, sf):
    _, assigned, cents = _cents(spark, sf)
    return joins.nearest_numpy(assigned.withColumnRenamed("cid", "own"), cents, RGB, current="own")


_PAIRS = (
    "prs AS (SELECT a.img_id, a.cid AS src, b.cid AS dst, ((a.r - b.r) ** 2 + (a.g - b.g) ** 2 + (a.b "
    "- b.b) ** 2)::BIGINT AS d2 FROM cent a JOIN cent b ON a.img_id = b.img_id AND a.cid <> b.cid)"
)


@query("jn_centroid_pairs", "WITH {PX}, {CENT}, " + _PAIRS + " SELECT * FROM prs")
def jn_centroid_pairs(spark, sf):
    return joins.centroid_pairs(_cents(spark, sf)[2], RGB)


@query("flt_not_self", "WITH {PX}, {CENT}, " + _PAIRS + " SELECT img_id, count(*) AS n FROM prs GROUP BY 1")
def flt_not_self(spark, sf):
    return joins.centroid_pairs(_cents(spark, sf)[2], RGB).groupBy("img_id").agg(F.count("*").alias("n"))


@query("jn_ngram_index", (
    "WITH {BYTES}, g AS (SELECT doc_id, pos, string_agg(lpad(hex(byte), 2, '0'), '' ORDER BY pos) OVER "
    "(PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS gram FROM byts) SELECT "
    "doc_id, pos, prev FROM (SELECT doc_id, pos, gram, min(pos) OVER (PARTITION BY doc_id, gram ORDER "
    "BY pos RANGE BETWEEN 65535 PRECEDING AND 1 PRECEDING) AS prev FROM g WHERE length(gram) = 12) WHERE "
    "prev IS NOT NULL"
))
def jn_ngram_index(spark, sf):
    return joins.ngram_matches(doc_bytes(spark, sf))


@query("wn_neighbour_rank", "WITH {PX}, {CENT}, " + _PAIRS + " SELECT *, row_number() OVER (PARTITION BY img_id, src ORDER BY d2, dst)::INT AS rank FROM prs")
def wn_neighbour_rank(spark, sf):
    return joins.neighbour_rank(joins.centroid_pairs(_cents(spark, sf)[2], RGB))


@query("so_neighbours", "WITH {PX}, {CENT}, " + _PAIRS + " SELECT img_id, src, list(dst ORDER BY d2, dst) AS dsts FROM prs GROUP BY ALL")
def so_neighbours(spark, sf):
    near = F.array_sort(F.collect_list(F.struct("d2", "dst")))
    return joins.centroid_pairs(_cents(spark, sf)[2], RGB).groupBy("img_id", "src").agg(F.transform(near, lambda s: s["dst"]).alias("dsts"))


@query("so_topk_neighbours", "WITH {PX}, {CENT}, " + _PAIRS + " SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY img_id, src ORDER BY d2, dst)::INT AS rank FROM prs) WHERE rank <= 2")
def so_topk_neighbours(spark, sf):
    """The floor of the list length: the root of k."""
    return joins.neighbour_rank(joins.centroid_pairs(_cents(spark, sf)[2], RGB), most=int(8**0.5))


@query("km_neighbours", "WITH {PX}, {CENT}, " + _PAIRS + " SELECT img_id, src AS cid, count(*) AS n, sqrt(min(d2)) / 2 AS radius FROM prs GROUP BY ALL")
def km_neighbours(spark, sf):
    c = _cents(spark, sf)[2]
    pairs = joins.centroid_pairs(c, RGB)
    n = pairs.groupBy("img_id", F.col("src").alias("cid")).agg(F.count("*").alias("n"))
    return n.join(joins.certainty_radius(pairs, c), ["img_id", "cid"])


@query("fn_certainty_radius", "WITH {PX}, {CENT}, " + _PAIRS + " SELECT img_id, src AS cid, sqrt(min(d2)) / 2 AS radius FROM prs GROUP BY ALL")
def fn_certainty_radius(spark, sf):
    c = _cents(spark, sf)[2]
    return joins.certainty_radius(joins.centroid_pairs(c, RGB), c)


# sorts


@query("so_codecs_by_mean", _REPORTS + "SELECT codec, row_number() OVER (ORDER BY avg(compression_ratio), codec)::INT AS place FROM rep GROUP BY 1")
def so_codecs_by_mean(spark, sf):
    mean = _reports(spark, sf).groupBy("codec").agg(F.avg("compression_ratio").alias("m"))
    return mean.select("codec", F.row_number().over(Window.orderBy("m", "codec")).alias("place"))


@query("so_dims_desc", (
    "WITH {PX}, {DIMS}, d AS (SELECT w || 'x' || h AS dims, count(*) AS cnt FROM dims GROUP BY 1) SELECT "
    "CASE WHEN cnt = 1 THEN 'singles' ELSE dims END AS dims, sum(cnt)::BIGINT AS cnt FROM d GROUP BY "
    "1"
))
def so_dims_desc(spark, sf):
    return metrics.bundled(metrics.dims_histogram(images(pixels(spark, sf))))


@query("so_color_counts", "WITH {PX}, {HIST} SELECT img_id, list(cnt ORDER BY cnt) AS cnts FROM hist GROUP BY 1")
def so_color_counts(spark, sf):
    return colours(pixels(spark, sf)).groupBy("img_id").agg(F.sort_array(F.collect_list("cnt")).alias("cnts"))


@query("so_take_n", "WITH {PX} SELECT img_id, pos, r FROM px WHERE pos < 32")
def so_take_n(spark, sf):
    """The first row of each picture."""
    return pixels(spark, sf).filter("pos < 32").select("img_id", "pos", "r")


# sets


@query("st_chain", (
    "WITH {PX}, {DIMS} SELECT img_id, 0 AS part, 0::BIGINT AS ord, w::BIGINT AS v FROM dims UNION ALL "
    "SELECT img_id, 0, 1, h FROM dims UNION ALL SELECT img_id, 1, pos, r FROM px"
))
def st_chain(spark, sf):
    px = pixels(spark, sf)
    row = lambda d, part, at, v: d.select("img_id", F.lit(part).alias("part"), F.lit(at).cast("long").alias("ord") if isinstance(at, int) else F.col(at).alias("ord"), F.col(v).cast("long").alias("v"))
    d = images(px)
    return row(d, 0, 0, "w").unionByName(row(d, 0, 1, "h")).unionByName(row(px, 1, "pos", "r"))


@query("st_distinct_symbols", "WITH {PX} SELECT DISTINCT r, g, b FROM px")
def st_distinct_symbols(spark, sf):
    return pixels(spark, sf).select(*RGB).distinct()


# functions


def _pair(spark, sf):
    a = pixels(spark, sf)
    b = pixels_flat(spark, sf)
    return a.join(b.select("img_id", "pos", *[F.col(c).alias(f"o{c}") for c in RGB]), ["img_id", "pos"])


_TWO = "WITH {PX}, {FLAT}, two AS (SELECT px.*, flat.r AS o_r, flat.g AS o_g, flat.b AS o_b FROM px JOIN flat USING (img_id, pos)) "
_D2 = "(r - o_r) ** 2 + (g - o_g) ** 2 + (b - o_b) ** 2"


def _ab(*names):
    return [F.col(c) for c in RGB], [F.col(f"o{c}") for c in RGB]


@query("fn_dist_rgb", _TWO + f"SELECT img_id, pos, sqrt({_D2}) AS d FROM two")
def fn_dist_rgb(spark, sf):
    return _pair(spark, sf).select("img_id", "pos", fn.dist(*_ab()).alias("d"))


@query("fn_dist_f64", _TWO + f"SELECT img_id, pos, sqrt({_D2}) AS d FROM two")
def fn_dist_f64(spark, sf):
    return _pair(spark, sf).select("img_id", "pos", fn.dist_f64(*_ab()).alias("d"))


@query("fn_dist_colorpos", _TWO + f"SELECT img_id, pos, sqrt({_D2} + (x - 16) ** 2 + (y - 16) ** 2) AS d FROM two")
def fn_dist_colorpos(spark, sf):
    a, b = _ab()
    return _pair(spark, sf).select("img_id", "pos", fn.dist([*a, F.col("x"), F.col("y")], [*b, F.lit(16), F.lit(16)]).alias("d"))


@query("fn_d2_xy", "WITH {PX} SELECT img_id, pos, ((x - 16) ** 2 + (y - 100) ** 2)::BIGINT AS d2 FROM px")
def fn_d2_xy(spark, sf):
    return pixels(spark, sf).select("img_id", "pos", fn.d2_xy(F.col("x"), F.col("y"), F.lit(16), F.lit(100)).alias("d2"))


@query("fn_vec_sub", _TWO + "SELECT img_id, pos, [r - o_r, g - o_g, b - o_b] AS v FROM two")
def fn_vec_sub(spark, sf):
    a, b = _ab()
    return _pair(spark, sf).select("img_id", "pos", fn.vec_sub(F.array(*a), F.array(*b)).alias("v"))


@query("fn_vec_add", _TWO + "SELECT img_id, pos, [r + o_r, g + o_g, b + o_b] AS v FROM two")
def fn_vec_add(spark, sf):
    a, b = _ab()
    return _pair(spark, sf).select("img_id", "pos", fn.vec_add(F.array(*a), F.array(*b)).alias("v"))


@query("fn_round_u8", "WITH {PX} SELECT img_id, pos, floor((r + g) / 2.0 + 0.5)::INT AS v FROM px")
def fn_round_u8(spark, sf):
    return pixels(spark, sf).select("img_id", "pos", fn.round_u8((F.col("r") + F.col("g")) / 2.0).alias("v"))


@query("fn_hilbert_xy2d", (
    "WITH RECURSIVE {PX}, sided AS (SELECT img_id, pos, r AS x, g AS y, 256 AS side FROM px), {HILB} "
    "SELECT img_id, pos, d AS hidx FROM cells WHERE s = 0"
))
def fn_hilbert_xy2d(spark, sf):
    return pixels(spark, sf).select("img_id", "pos", fn.hilbert_index(F.col("r"), F.col("g"), F.lit(256)).alias("hidx"))


@query("fn_next_pow2", (
    "WITH {PX} SELECT img_id, pos, CASE WHEN pos <= 1 THEN 1 ELSE 2 ** length(bin(pos - 1)) END::BIGINT "
    "AS p, CASE WHEN pos <= 1 THEN 0 ELSE 2 ** (length(bin(pos - 1)) - 1) END::BIGINT AS half FROM px"
))
def fn_next_pow2(spark, sf):
    p = fn.next_pow2(F.col("pos"))
    return pixels(spark, sf).select("img_id", "pos", p.cast("long").alias("p"), F.shiftright(p, 1).cast("long").alias("half"))


@query("fn_push_bit", "WITH {PX} SELECT img_id, pos, (r * 2) % 256 + g % 2 AS msb, r // 2 + (g % 2) * 128 AS lsb FROM px")
def fn_push_bit(spark, sf):
    bit = F.col("g") % 2
    return pixels(spark, sf).select("img_id", "pos", fn.push_bit(F.col("r"), bit).alias("msb"), fn.push_bit(F.col("r"), bit, False).alias("lsb"))


@query("fn_nth", "WITH {PX} SELECT img_id, pos, (r >> (7 - x % 8)) & 1 AS msb, (r >> (x % 8)) & 1 AS lsb FROM px")
def fn_nth(spark, sf):
    i = F.col("x") % 8
    return pixels(spark, sf).select("img_id", "pos", fn.nth(F.col("r"), i).alias("msb"), fn.nth(F.col("r"), i, False).alias("lsb"))


@query("fn_bit_array", "WITH {PX} SELECT img_id, pos, lpad(bin(r), 8, '0') AS msb, reverse(lpad(bin(r), 8, '0')) AS lsb FROM px")
def fn_bit_array(spark, sf):
    return pixels(spark, sf).select("img_id", "pos", fn.bit_string(F.col("r")).alias("msb"), fn.bit_string(F.col("r"), False).alias("lsb"))


@query("fn_bit_mask", "WITH {PX} SELECT img_id, pos, least(2 ** (x % 10), 256)::INT - 1 AS mask FROM px")
def fn_bit_mask(spark, sf):
    return pixels(spark, sf).select("img_id", "pos", fn.bit_mask(F.col("x") % 10).alias("mask"))


@query("fn_bit_byte", "WITH {PX} SELECT img_id, pos, CASE WHEN r > g THEN 1 ELSE 0 END AS bit FROM px")
def fn_bit_byte(spark, sf):
    return pixels(spark, sf).select("img_id", "pos", (F.col("r") > F.col("g")).cast("int").alias("bit"))


@query("fn_byte_from_slice", "WITH {PX} SELECT img_id, pos, CASE WHEN x % 3 = 0 THEN NULL ELSE r END AS byte FROM px")
def fn_byte_from_slice(spark, sf):
    bits = fn.bit_string(F.col("r"))
    return pixels(spark, sf).select("img_id", "pos", fn.byte_from_bits(F.when(F.col("x") % 3 == 0, F.substring(bits, 1, 7)).otherwise(bits)).alias("byte"))


@query("fn_bits_pack", "WITH {PX} SELECT img_id, y, string_agg(lpad(hex(r), 2, '0') , '' ORDER BY pos) AS packed FROM px GROUP BY ALL")
def fn_bits_pack(spark, sf):
    """Each picture row's red channel, written bit by bit."""
    bits = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "r"))), lambda s: fn.bit_string(s["r"])), "")
    return pixels(spark, sf).groupBy("img_id", "y").agg(bits.alias("bits")).select("img_id", "y", F.hex(fn.pack_bits(F.col("bits"))).alias("packed"))


@query("fn_bit_reader", "WITH {PX} SELECT img_id, pos, lpad(bin(r), 8, '0') || lpad(bin(g), 8, '0') AS bits FROM px")
def fn_bit_reader(spark, sf):
    return pixels(spark, sf).select("img_id", "pos", fn.unpack_bits(F.concat(fn.le(F.col("r"), 1), fn.le(F.col("g"), 1))).alias("bits"))


def _le_sql(v: str, n: int) -> str:
    return " || ".join(f"lpad(hex((({v}) >> {8 * k}) & 255), 2, '0')" for k in range(n))


@query("fn_ser", (
    f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_le_sql('l_partkey & 255', 1)} AS u8, {_le_sql('l_partkey & 65535', 2)} "
    f"AS u16, {_le_sql('l_partkey', 4)} AS u32, {_le_sql('l_partkey', 8)} AS u64 FROM lineitem"
))
def fn_ser(spark, sf):
    v = F.col("l_partkey")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[F.hex(fn.le(v, n)).alias(f"u{8 * n}") for n in (1, 2, 4, 8)])


@query("fn_deser", "SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey AS u64, l_partkey & 65535 AS u16, -(l_suppkey % 300) AS i16 FROM lineitem")
def fn_deser(spark, sf):
    v = F.col("l_partkey")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", fn.from_le(fn.le(v, 8), 8).alias("u64"), fn.from_le(fn.le(v, 2), 2).alias("u16"), fn.from_le(fn.le(-(F.col("l_suppkey") % 300), 2), 2, True).alias("i16"))


@query("fn_ser_pixel", "WITH {PX} SELECT img_id, pos, '0300000000000000' || lpad(hex(r), 2, '0') || lpad(hex(g), 2, '0') || lpad(hex(b), 2, '0') AS wire FROM px")
def fn_ser_pixel(spark, sf):
    return pixels(spark, sf).select("img_id", "pos", F.hex(fn.ser_pixel(*[F.col(c) for c in RGB])).alias("wire"))


@query("fn_ser_signed", "WITH {PX}, " + _DELTA + " SELECT img_id, pos, " + " || ".join(_le_sql(f"d{c} & 65535", 2) for c in "rgb") + " AS wire FROM dl")
def fn_ser_signed(spark, sf):
    d = sequence.delta(pixels(spark, sf), ["img_id"], "pos")
    return d.select("img_id", "pos", F.hex(fn.ser_signed(*[F.col(f"d{c}") for c in RGB])).alias("wire"))


@query("fn_ser_stream", "WITH {PX} SELECT img_id, y, string_agg(lpad(hex(r), 2, '0') || '00', '' ORDER BY pos) AS wire FROM px GROUP BY ALL")
def fn_ser_stream(spark, sf):
    """A picture row of 16-bit values as one byte stream."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "r"))), lambda s: F.hex(fn.le(s["r"], 2)))
    return pixels(spark, sf).groupBy("img_id", "y").agg(F.array_join(parts, "").alias("wire"))


@query("fn_deser_stream", "WITH {PX} SELECT img_id, y, list(r ORDER BY pos) AS v FROM px GROUP BY ALL")
def fn_deser_stream(spark, sf):
    n = F.octet_length("d") / 2
    s = fn_ser_stream(spark, sf).select("img_id", "y", F.unhex("wire").alias("d"))
    at = s.select("img_id", "y", "d", F.posexplode(F.sequence(F.lit(0), n.cast("int") - 1)).alias("i", "k"))
    return at.select("img_id", "y", "i", fn.from_le(F.substring("d", F.col("k") * 2 + 1, F.lit(2)), 2).cast("int").alias("v")).groupBy("img_id", "y").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("v"))


@query("fn_compress_len", "WITH {PX} SELECT img_id, pos, (r * 128 + g) + (x % 2) * 32768 AS packed FROM px")
def fn_compress_len(spark, sf):
    return pixels(spark, sf).select("img_id", "pos", fn.compress_len(F.col("r") * 128 + F.col("g"), F.col("x") % 2).alias("packed"))


@query("fn_decompress_len", "WITH {PX} SELECT img_id, pos, x % 2 AS tag, r * 128 + g AS len FROM px")
def fn_decompress_len(spark, sf):
    return fn_compress_len(spark, sf).select("img_id", "pos", fn.decompress_len(F.col("packed")).alias("m")).select("img_id", "pos", "m.*")


@query("fn_compression_ratio", _REPORTS + (
    "SELECT codec, name, compressed_size::DOUBLE / (w * h * 24) * 100 AS ratio_ref, compressed_size::DOUBLE "
    "/ (w * h * 3) * 100 AS ratio_true FROM rep JOIN dims ON rep.name = dims.img_id::VARCHAR"
))
def fn_compression_ratio(spark, sf):
    rep, d = _reports(spark, sf), images(pixels(spark, sf)).withColumn("name", F.col("img_id").cast("string"))
    c = [F.col("compressed_size"), F.col("w"), F.col("h")]
    return rep.join(d, "name").select("codec", "name", metrics.ratio_ref(*c).alias("ratio_ref"), metrics.ratio_true(*c).alias("ratio_true"))


@query("fn_raw_size", "WITH {PX}, {DIMS} SELECT img_id, w::BIGINT * h * 24 AS raw_size FROM dims")
def fn_raw_size(spark, sf):
    return images(pixels(spark, sf)).select("img_id", metrics.raw_size(F.col("w"), F.col("h")).alias("raw_size"))


_URLS = (
    "SELECT page_id, 'output/' || regexp_extract(url, '([^/]*?)(\\.[^./]*)?$', 1) || '.png' AS path, "
    "regexp_extract(url, '([^/]*?)(\\.[^./]*)?$', 1) AS name FROM pages"
)


@query("fn_under_output", _URLS.replace(" AS path, regexp_extract(url, '([^/]*?)(\\.[^./]*)?$', 1) AS name", " AS path"))
def fn_under_output(spark, sf):
    return table(spark, sf, "pages").select("page_id", reports.under_output(F.col("url"), "png").alias("path"))


@query("fn_display_name", "SELECT page_id, regexp_extract(url, '([^/]*?)(\\.[^./]*)?$', 1) AS name FROM pages")
def fn_display_name(spark, sf):
    return table(spark, sf, "pages").select("page_id", reports.display_name(F.col("url")).alias("name"))


# k-means


@query("km_init_assignment", "WITH {PX}, {CENT} SELECT img_id, pos, cid FROM ini")
def km_init_assignment(spark, sf):
    return kmeans.init_assignment(pixels(spark, sf), 8).select("img_id", "pos", "cid")


@query("km_init_centroids", "WITH {PX}, {CENT} SELECT * FROM cent")
def km_init_centroids(spark, sf):
    return _cents(spark, sf)[2]


_STEP = "WITH {PX}, {CENT}, moved AS (" + _ASSIGN + ") "


@query("km_assign", _STEP + "SELECT * FROM moved")
def km_assign(spark, sf):
    _, assigned, cents = _cents(spark, sf)
    return kmeans.assign(assigned, cents, RGB, 8).select("img_id", "pos", "cid", "d2")


@query("km_update_centroids", _STEP + (
    "SELECT img_id, moved.cid, (sum(r) // count(*))::INT AS r, (sum(g) // count(*))::INT AS g, (sum(b) "
    "// count(*))::INT AS b FROM moved JOIN px USING (img_id, pos) GROUP BY ALL"
))
def km_update_centroids(spark, sf):
    _, assigned, cents = _cents(spark, sf)
    return kmeans.update_centroids(kmeans.assign(assigned, cents, RGB, 8).withColumn("cnt", F.lit(1)), RGB)


_NEAR_5D = """
    SELECT i.img_id, i.pos,
           arg_min(c.cid, (({0}) * 2 + CASE WHEN c.cid = i.cid THEN 0 ELSE 1 END) * 8 + c.cid) AS cid, min({0})::BIGINT AS d2
    FROM ini i JOIN cent c USING (img_id) GROUP BY ALL
""".replace("{0}", " + ".join(f"(i.{f} - c.{f}) * (i.{f} - c.{f})" for f in kmeans.PLACE))


@query("km_assign_pruned", "WITH {PX}, {CENT} " + _NEAR_5D)
def km_assign_pruned(spark, sf):
    """Places and colours, along neighbour lists that begin short and grow."""
    assigned = written(kmeans.init_assignment(pixels(spark, sf), 8), "points")
    return pruned.assign_pruned(assigned, kmeans.init_centroids(assigned, kmeans.PLACE), kmeans.PLACE, lengths=1).select("img_id", "pos", "cid", "d2")


_COUNTERS = """
    WITH {PX}, {CENT}, moved AS ({ASSIGN}), {PAIRS},
    near AS (SELECT img_id, src AS cid, min(d2) AS m FROM prs GROUP BY ALL),
    own AS (
        SELECT i.img_id, i.pos, i.cid, (i.r - c.r) ** 2 + (i.g - c.g) ** 2 + (i.b - c.b) ** 2 AS d2
        FROM ini i JOIN cent c USING (img_id, cid)
    ),
    looked AS (
        SELECT own.img_id, own.pos, count(*) FILTER (prs.d2 <= 4 * own.d2) AS t, count(*) AS n
        FROM own JOIN prs ON prs.img_id = own.img_id AND prs.src = own.cid GROUP BY ALL
    ),
    each AS (
        SELECT o.img_id, m.cid <> o.cid AS moves, 4 * o.d2 <= r.m AS sure, l.t, l.n
        FROM own o JOIN moved m USING (img_id, pos) JOIN looked l USING (img_id, pos)
        JOIN near r ON r.img_id = o.img_id AND r.cid = o.cid
    )
    SELECT img_id, 1 AS round, count(*) FILTER (moves) AS moved, count(*) FILTER (NOT moves) AS stayed,
           count(*) FILTER (sure) AS by_radius, count(*) FILTER (NOT sure AND t < n) AS by_cutoff,
           sum(CASE WHEN sure THEN 0 ELSE t END)::BIGINT AS tested, max(CASE WHEN sure THEN 0 ELSE t END) AS most_tested,
           0::BIGINT AS grew
    FROM each GROUP BY img_id
""".replace("{ASSIGN}", _ASSIGN).replace("{PAIRS}", _PAIRS)


@query("km_round_counters", _COUNTERS)
def km_round_counters(spark, sf):
    """What a round did: points that moved and stayed, that the certainty radius or a neighbour ended early, centroids compared."""
    points = pixels(spark, sf).withColumn("cnt", F.lit(1))
    return pruned.kmeans_rounds(points, 8, RGB, max_iter=1)[2]


def _unrolled(rounds: int) -> str:
    parts = ["c0 AS (SELECT img_id, cid, r, g, b FROM cent)", "a0 AS (SELECT img_id, pos, r, g, b, cid FROM ini)"]
    d2 = " + ".join(f"(a.{f} - c.{f}) * (a.{f} - c.{f})" for f in RGB)
    for i in range(rounds):
        parts += [
            (
                f"m{i} AS (SELECT a.img_id, a.pos, arg_min(c.cid, (({d2}) * 2 + (c.cid <> a.cid)::INT) * 8 + c.cid) "
                f"AS cid FROM a{i} a JOIN c{i} c USING (img_id) GROUP BY ALL)"
            ),
            f"a{i + 1} AS (SELECT m.img_id, m.pos, a.r, a.g, a.b, m.cid FROM m{i} m JOIN a{i} a USING (img_id, pos))",
            f"c{i + 1} AS (SELECT img_id, cid, " + ", ".join(f"(sum({f}) // count(*))::INT AS {f}" for f in RGB) + f" FROM a{i + 1} GROUP BY ALL)",
        ]
    return "WITH {PX}, {CENT}, " + ", ".join(parts) + f" SELECT img_id, cid::INT AS cid, r, g, b, count(*) AS n FROM c{rounds} JOIN (SELECT img_id, cid FROM a{rounds}) USING (img_id, cid) GROUP BY ALL"


@query("km_rounds", _unrolled(3))
def km_rounds(spark, sf):
    """Centroids and their points after three rounds, each a plan over blocks of all rasters."""
    points = pixels(spark, sf).withColumn("cnt", F.lit(1))
    mine, centroids, _ = pruned.kmeans_rounds(points, 8, RGB, max_iter=3)
    return centroids.join(mine.groupBy("img_id", "cid").agg(F.count("*").alias("n")), ["img_id", "cid"]).select("img_id", "cid", *RGB, "n")


@query("km_cluster")
def km_cluster(spark, sf):
    """Colours of each raster in eight clusters, to the end."""
    cols = colours(pixels(spark, sf)).withColumn("pos", (F.col("r") * 65536 + F.col("g") * 256 + F.col("b")).cast("long"))
    points, centroids = kmeans.kmeans(cols, 8, RGB)
    n = points.groupBy("img_id", "cid").agg(F.sum("cnt").alias("n"))
    return centroids.join(n, ["img_id", "cid"], "left")


@query("km_cluster_fixed_point", "WITH {PX} SELECT img_id, true AS fixed, count(*) AS n FROM px GROUP BY 1")
def km_cluster_fixed_point(spark, sf):
    """After the last round no point is nearer to another centroid, and none is lost."""
    cols = colours(pixels(spark, sf)).withColumn("pos", (F.col("r") * 65536 + F.col("g") * 256 + F.col("b")).cast("long"))
    points, centroids = kmeans.kmeans(cols, 8, RGB)
    near = joins.nearest(points.withColumnRenamed("cid", "own"), centroids, RGB, current="own")
    both = points.select("img_id", "pos", "cnt", F.col("cid").alias("own")).join(near, ["img_id", "pos"])
    return both.groupBy("img_id").agg(F.min(F.col("own") == F.col("cid")).alias("fixed"), F.sum("cnt").alias("n"))


# codecs


_BITS = (
    "w0 AS (SELECT key, list(cnt ORDER BY cnt) AS w, 0::BIGINT AS bits FROM h GROUP BY key), tree AS "
    "(SELECT key, w, bits FROM w0 UNION ALL SELECT key, list_sort(list_append(w[3:], w[1] + w[2])), bits "
    "+ w[1] + w[2] FROM tree WHERE len(w) > 1), fin AS (SELECT key, bits FROM tree WHERE len(w) = 1)"
)


@query("huf_build", "WITH RECURSIVE {BYTES}, h AS (SELECT doc_id AS key, byte, count(*) AS cnt FROM byts GROUP BY ALL), " + _BITS + (
    " SELECT key AS doc_id, n, bits AS payload_bits, 8 + 2 * n + n - 1 + (bits + 7) // 8 AS size, 1.0 "
    "AS kraft FROM fin JOIN (SELECT key, count(*) AS n FROM h GROUP BY 1) USING (key) UNION ALL SELECT "
    "doc_id, 0, 0, 8, 0.0 FROM documents WHERE coalesce(text, '') = ''"
))
def huf_build(spark, sf):
    """Code lengths of each document's bytes: their weighted sum is least, and they fill the code space."""
    return huffman.byte_sizes(doc_bytes(spark, sf))


@query("cd_hufman_size", "WITH RECURSIVE {FLAT}, h AS (SELECT img_id AS key, r, g, b, count(*) AS cnt FROM flat GROUP BY ALL), " + _BITS + (
    " SELECT key AS img_id, n, bits AS payload_bits, 8 + 12 * n + n - 1 + (bits + 7) // 8 AS size FROM "
    "fin JOIN (SELECT key, count(*) AS n FROM h GROUP BY 1) USING (key)"
))
def cd_hufman_size(spark, sf):
    return huffman.sizes(huffman.codebook(colours(pixels_flat(spark, sf)), RGB), 11)


_MEASURED = "WITH {PX} SELECT img_id::VARCHAR AS name, count(*) AS n_pixels, true AS ok, 0.0::DOUBLE AS error FROM px GROUP BY 1"


def _round_trip(name: str, codec: codecs.Codec):
    @query(f"{name}_lossless", _MEASURED)
    def lossless(spark, sf):
        """Every raster decodes to itself."""
        rows = measured(pixels(spark, sf), [codec])
        return rows.select(F.col("img_id").cast("string").alias("name"), "n_pixels", F.col("error_msg").isNull().alias("ok"), "error")

    return lossless


cd_hufman = _round_trip("cd_hufman", codecs.Hufman())
cd_delta = _round_trip("cd_delta", codecs.Delta())
cd_hilbert_rle = _round_trip("cd_hilbert_rle", codecs.HilbertRle())
cd_hilbert_zip = _round_trip("cd_hilbert_zip", codecs.HilbertZip())
cd_zip_dict = _round_trip("cd_zip_dict", codecs.ZipDict())
cd_zip_back = _round_trip("cd_zip_back", codecs.ZipBack())


@query("cd_cluster_colors")
def cd_cluster_colors(spark, sf):
    return measure(pixels(spark, sf), codecs.ClusterColours(16))


@query("cd_voronoi")
def cd_voronoi(spark, sf):
    return measure(pixels(spark, sf), codecs.Voronoi(16))


@query("cd_voronoi_size", "WITH {PX}, {DIMS} SELECT img_id, 16 + 19 * 16 AS size FROM dims")
def cd_voronoi_size(spark, sf):
    return codecs.Voronoi(16).encode(pixels(spark, sf)).select("img_id", F.octet_length("encoded").alias("size"))


def coded_texts(data: DataFrame, one: Callable[[bytes], tuple], schema: str) -> DataFrame:
    """doc_id and what `one` gives for the bytes of each text. A text's symbols are gone before the next one's are made; only
    its row of results is kept, for as many texts as a batch has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, TEXTS):
                part = batch.slice(i, TEXTS)
                rows = [one(x.as_buffer().to_pybytes()) for x in part.column(1)]
                yield pa.record_batch([part.column(0), *map(pa.array, zip(*rows, strict=True))], schema=fields)

    whole = f"doc_id long, {schema}"
    fields = to_arrow_schema(StructType.fromDDL(whole))
    return data.select(F.col("doc_id").cast("long").alias("doc_id"), "data").mapInArrow(run, whole)


def _text_coder(name: str, symbols: Callable, pack: Callable, unpack: Callable, back: Callable):
    @query(name)
    def coded(spark, sf):
        """Symbols and bytes of each document's text."""

        def one(data: bytes) -> tuple[int, int, int, bool]:
            s = symbols(data)
            wire = pack(s)
            return len(data), len(s), len(wire), back(unpack(wire)) == data

        return coded_texts(doc_bytes(spark, sf), one, "n_bytes long, n_symbols long, encoded_bytes long, lossless boolean")

    @query(f"{name}_lossless", "SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n_bytes, true AS lossless FROM documents")
    def lossless(spark, sf):
        return coded(spark, sf).select("doc_id", "n_bytes", "lossless")

    return coded, lossless


sf_zipdict = _text_coder("sf_zipdict", lz.dict_symbols, lz.dict_bytes, lz.dict_parse, lz.dict_decode)
sf_zipback = _text_coder("sf_zipback", lz.back_symbols, lz.back_bytes, lz.back_parse, lz.back_decode)


@query("ag_trie_stats")
def ag_trie_stats(spark, sf):
    """Of each text's dictionary: values, trie nodes, nodes with children."""

    def run(frames):
        import pandas as pd

        for pdf in frames:
            got = [lz.trie_stats(lz.dict_symbols(bytes(x))) for x in pdf["data"]]
            yield pd.DataFrame({"doc_id": pdf.doc_id, "n_values": [g[0] for g in got], "n_nodes": [g[1] for g in got], "n_inner": [g[2] for g in got]})

    return doc_bytes(spark, sf).mapInPandas(run, "doc_id long, n_values long, n_nodes long, n_inner long")


@query("huf_tree_ser", (
    "WITH {FLAT}, h AS (SELECT img_id, count(DISTINCT (r, g, b)) AS n FROM flat GROUP BY 1) SELECT img_id, "
    "n, 12 * n + n - 1 AS tree_bytes, true AS same FROM h"
))
def huf_tree_ser(spark, sf):
    """Each raster's tree written and read back."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        root = huffman.tree({tuple(s): n for *s, n in pdf[[*RGB, "cnt"]].itertuples(index=False, name=None)})
        data = huffman.dump(root, huffman.RGB[1])
        back, end = huffman.parse(data, 0, huffman.RGB[0], huffman.RGB[2])
        return pd.DataFrame({"img_id": [pdf.img_id.iloc[0]], "n": [len(pdf)], "tree_bytes": [len(data)], "same": [huffman.codes(back) == huffman.codes(root) and end == len(data)]})

    return colours(pixels_flat(spark, sf)).groupBy("img_id").applyInPandas(run, "img_id long, n long, tree_bytes long, same boolean")


@query("zb_symbol_ser", "WITH {PX} SELECT img_id, pos, CASE WHEN x % 2 = 1 THEN " + _le_sql("(r * 100) | 32768", 2) + " || " + _le_sql("g * 600", 2) + " ELSE " + _le_sql("1", 2) + " || lpad(hex(r), 2, '0') END AS wire FROM px")
def zb_symbol_ser(spark, sf):
    """Look-back and explicit symbols as bytes."""
    look = F.concat(fn.le(fn.compress_len(F.col("r") * 100, F.lit(1)), 2), fn.le(F.col("g") * 600, 2))
    plain = F.concat(fn.le(fn.compress_len(F.lit(1), F.lit(0)), 2), fn.le(F.col("r"), 1))
    return pixels(spark, sf).select("img_id", "pos", F.hex(F.when(F.col("x") % 2 == 1, look).otherwise(plain)).alias("wire"))


# streams


def _events(spark, sf) -> DataFrame:
    schema = table(spark, sf, "events").schema
    cents = F.floor(F.col("value") * 100 + 0.5).cast("long").alias("value_cents")
    return spark.readStream.schema(schema).parquet(f"{sf}/events.parquet*").select("user_id", "event_id", "ts", "event_type", cents)


@query("sf_delta", "WITH {EV} SELECT user_id, value_cents, value_cents - coalesce(lag(value_cents) OVER (PARTITION BY user_id ORDER BY pos), 0) AS diff FROM ev")
def sf_delta(spark, sf):
    """A stream of differences over the events, read to its end."""
    return stateful.to_end(stateful.stream_deltas(_events(spark, sf)), new_folder(spark, "stream")).select("user_id", "value_cents", "diff")


@query("sf_rle", (
    "WITH {EV}, a AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER "
    "BY pos) THEN 0 ELSE 1 END AS nw FROM ev), b AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER "
    "BY pos) AS run FROM a) SELECT user_id, run::BIGINT - 1 AS seq, count(*)::INT AS cnt, any_value(event_type) "
    "AS event_type FROM b GROUP BY user_id, run"
))
def sf_rle(spark, sf):
    """A stream of runs over the events, read to its end: finished ones, and each user's last from the state."""
    folder = new_folder(spark, "stream")
    done = stateful.to_end(stateful.stream_runs(_events(spark, sf)), folder)
    return done.unionByName(stateful.open_runs(spark, f"{folder}/state"))
