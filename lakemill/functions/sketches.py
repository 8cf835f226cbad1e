"""HyperLogLog and quantile sketches.

HyperLogLog maps to Spark's DataSketches functions (2 to the 14 buckets).  The
t-digest functions keep their names and work on KLL sketches of doubles, which
answer the same questions; a digest is the struct (sketch, count, sum) so that
counts and sums stay exact.
"""

from __future__ import annotations

from lakemill.functions.registry import double, simple, sql_function, text

LG = 14


def _one_hll(v: str) -> str:
    """A sketch of literal arguments: aggregated over the array's elements by a scalar subquery."""
    return f"(SELECT hll_sketch_agg(x, {LG}) FROM (SELECT explode(array({v})) AS x))"


@sql_function("hll_init")
def _hll_init(*values: str) -> str:
    return _one_hll(", ".join(map(text, values)))


@sql_function("hll_add")
def _hll_add(h: str, *values: str) -> str:
    added = _one_hll(", ".join(map(text, values)))
    return f"CASE WHEN ({h}) IS NULL THEN {added} ELSE hll_union({h}, {added}) END"


@sql_function("hll_merge")
def _hll_merge(*sketches: str) -> str:
    out = sketches[0]
    for s in sketches[1:]:
        out = f"hll_union({out}, {s})"
    return out


simple("hll_estimate", "coalesce(hll_sketch_estimate({0}), 0L)")


def digest_of(column: str) -> str:
    """The aggregate that builds a digest."""
    return f"named_struct('sketch', kll_sketch_agg_double({double(column)}), 'n', CAST(count({double(column)}) AS DOUBLE), 'total', coalesce(sum({double(column)}), 0D))"


def merged_digest(column: str) -> str:
    """The aggregate that merges digests."""
    return f"named_struct('sketch', kll_merge_agg_double({column}.sketch), 'n', sum({column}.n), 'total', sum({column}.total))"


@sql_function("tdigest_build")
def _build(*values: str) -> str:
    return f"(SELECT {digest_of('x')} FROM (SELECT explode(array({', '.join(map(double, values))})) AS x))"


@sql_function("tdigest_add")
def _add(t: str, *values: str) -> str:
    return _merge(t, _build(*values))


@sql_function("tdigest_merge")
def _merge(*digests: str) -> str:
    out = digests[0]
    for d in digests[1:]:
        out = f"named_struct('sketch', kll_sketch_merge_double({out}.sketch, {d}.sketch), 'n', {out}.n + {d}.n, 'total', {out}.total + {d}.total)"
    return out


simple("tdigest_total_sum", "({0}).total")
simple("tdigest_total_count", "({0}).n")
simple("tdigest_percentile", "CASE WHEN {1} BETWEEN 0 AND 1 THEN kll_sketch_get_quantile_double(({0}).sketch, CAST({1} AS DOUBLE)) END")
simple("tdigest_location", "kll_sketch_get_rank_double(({0}).sketch, CAST({1} AS DOUBLE))")
