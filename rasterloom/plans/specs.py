"""Queries that read codec specifications, one for each order: every form that is accepted and some that are not, with numbers
from the table. The SQL side reads them by regular expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.plans import spec
from rasterloom.plans.queries import query
from rasterloom.sources.tables import table

#: {k} is a customer's number, {w} an order's priority.
FORMS = [
    "cluster-colors({k})", "c-col({k})", "x cluster-colors({k}) y", "clustercol({k})", "voronoi({k})", "my voronoi({k})",
    "hilbert(rle)", "Hilbert(rle({k}))", "hilbert(rle({k}.5))", "hilbert(zip)", "delta", "HUFMAN", "zip(dict)", "zip(back)",
    "colors({k})", "voronoi(x{k})", "hilbert(rle())", "hilbert(rle(-{k}))", "hilbert(rle,zip)", "Delta", "zip({k})", "huffman", "{w}", "hilbert",
]
CALLS = ["{k}", "a(", "a{k}()", "a({k}", "a({k})", "a({k},", "a({k},)", "a({k},{w})", "()", "({k})", "a(b(c,{k}),e)", "a({k}))", "a({k})c", "f(,{k})", "f({k},g(1,2),{w})"]


def _text(forms: list[str]) -> str:
    """An expression that both dialects read: the form whose turn an order is."""
    each = lambda f: "'" + f.replace("{k}", "' || o_custkey || '").replace("{w}", "' || o_orderpriority || '") + "'"
    return f"CASE o_orderkey % {len(forms)} " + " ".join(f"WHEN {i} THEN {each(f)}" for i, f in enumerate(forms)) + " END"


_CLUSTER, _VORONOI = r"c(?:luster)?-?col(?:ors)?\((\d+)\)", r"voronoi\((\d+)\)"
_NAME = rf"""CASE
    WHEN regexp_matches(spec, '{_CLUSTER}') THEN 'cluster-colors_' || regexp_extract(spec, '{_CLUSTER}', 1)
    WHEN regexp_matches(spec, '{_VORONOI}') THEN 'voronoi_' || regexp_extract(spec, '{_VORONOI}', 1)
    WHEN spec = 'delta' THEN 'delta'
    WHEN regexp_matches(spec, '^[Hh]ilbert\(rle(\(-?0\))?\)$') THEN 'hilbert-rle'
    WHEN regexp_matches(spec, '^[Hh]ilbert\(rle\([0-9.]+\)\)$') THEN 'hilbert-rle-approx_' || regexp_extract(spec, '[0-9.]+')
    WHEN regexp_matches(spec, '^[Hh]ilbert\(zip\)$') THEN 'hilbert-zip'
    WHEN lower(spec) = 'hufman' THEN 'Hufman'
    WHEN regexp_matches(spec, '^zip\((dict|back)\)$') THEN 'zip-' || regexp_extract(spec, '\((\w+)\)', 1) END"""
_READ = f"WITH s AS (SELECT o_orderkey, {_text(FORMS)} AS spec FROM orders), n AS (SELECT *, {_NAME} AS name FROM s) "
_LOSSLESS = "name NOT LIKE 'cluster%' AND name NOT LIKE 'voronoi%' AND name NOT LIKE '%approx%'"


def specifications(spark, sf, forms: list[str] = FORMS) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", F.expr(_text(forms)).alias("spec"))


def _told(rows: DataFrame, schema: str, read) -> DataFrame:
    """o_orderkey, spec and what read() makes of it, a struct; null where it refuses."""

    @F.udf(schema, useArrow=True)
    def told(text):
        try:
            return read(text)
        except ValueError:
            return None

    return rows.select("o_orderkey", "spec", told("spec").alias("r"))


@query("cd_registry", _READ + f"SELECT o_orderkey, spec, name, {_LOSSLESS} AS is_lossless FROM n WHERE name IS NOT NULL")
def cd_registry(spark, sf):
    """The codec that each accepted specification names."""

    def read(text):
        codec = spec.parse(text)
        return codec.name, codec.is_lossless

    return _told(specifications(spark, sf), "name string, is_lossless boolean", read).filter("r IS NOT NULL").select("o_orderkey", "spec", "r.*")


@query("fn_codec_name", _READ + "SELECT o_orderkey, name FROM n")
def fn_codec_name(spark, sf):
    return _told(specifications(spark, sf), "name string", lambda s: (spec.parse(s).name,)).select("o_orderkey", "r.name")


@query("fn_is_lossless", _READ + f"SELECT o_orderkey, {_LOSSLESS} AS is_lossless FROM n")
def fn_is_lossless(spark, sf):
    return _told(specifications(spark, sf), "x boolean", lambda s: (spec.parse(s).is_lossless,)).select("o_orderkey", F.col("r.x").alias("is_lossless"))


_ARG = r"[^(),]+(?:\([^()]*\))?"


@query(
    "ps_fun_call",
    f"WITH s AS (SELECT o_orderkey, {_text(CALLS)} AS spec FROM orders),"
    rf" i AS (SELECT *, regexp_full_match(spec, '[^(),]+\((?:{_ARG}(?:,{_ARG})*)?\)') AS ok,"
    r" regexp_replace(regexp_extract(spec, '^[^(),]+\((.*)\)$', 1), '\([^()]*\)', '', 'g') AS flat FROM s)"
    " SELECT o_orderkey, spec, ok, CASE WHEN NOT ok THEN NULL WHEN flat = '' THEN 0 ELSE length(flat) - length(replace(flat, ',', '')) + 1 END::INT AS n FROM i",
)
def ps_fun_call(spark, sf):
    """Whether a text is a call, and of how many arguments."""

    def read(text):
        call = spec.as_call(text)
        return None if call is None else (len(call.arguments),)

    return _told(specifications(spark, sf, CALLS), "n int", read).select("o_orderkey", "spec", F.col("r").isNotNull().alias("ok"), "r.n")


def _family(name: str, sql: str, read):
    @query(name, _READ + f"SELECT o_orderkey, {sql} AS read FROM n")
    def one(spark, sf):
        return _told(specifications(spark, sf), "read string", lambda s: (read(s),)).select("o_orderkey", "r.read")

    one.__doc__ = "What one family makes of each specification; null where it is not of the family."
    return one


def _only(prefix: str):
    def read(text: str) -> str:
        name = spec.parse(text).name
        if not name.startswith(prefix):
            raise spec.SpecError(f"{name} is of another family")
        return name

    return f"CASE WHEN name LIKE '{prefix}%' THEN name END", read


_family("ps_cluster", f"nullif(regexp_extract(spec, '{_CLUSTER}', 1), '')", lambda s: str(spec.cluster(s)))
_family("ps_voronoi", f"nullif(regexp_extract(spec, '{_VORONOI}', 1), '')", lambda s: str(spec.voronoi(s)))
for _query, _prefix in (("ps_hilbert", "hilbert"), ("ps_delta", "delta"), ("ps_hufman", "Hufman"), ("ps_zip", "zip")):
    _family(_query, *_only(_prefix))
