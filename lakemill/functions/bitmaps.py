"""Bitmaps as sorted arrays of distinct BIGINT."""

from __future__ import annotations

from lakemill.functions.registry import bigint, simple, sql_function


def values(*args: str) -> str:
    return f"array_sort(array_distinct(array_compact(array({', '.join(map(bigint, args))}))))" if args else "CAST(array() AS ARRAY<BIGINT>)"


def _fold(args: tuple[str, ...], join) -> str:
    out = args[0]
    for a in args[1:]:
        out = join(out, a)
    return f"array_sort({out})"


def _xor(a: str, b: str) -> str:
    return f"array_union(array_except({a}, {b}), array_except({b}, {a}))"


def _range(lo: str, hi: str) -> str:
    return f"CASE WHEN {bigint(hi)} > {bigint(lo)} THEN sequence({bigint(lo)}, {bigint(hi)} - 1) ELSE CAST(array() AS ARRAY<BIGINT>) END"


sql_function("rb_build")(values)


@sql_function("rb_and", "rb_and_null2empty")
def _and(*args: str) -> str:
    return _fold(args, lambda a, b: f"array_intersect({a}, {b})")


@sql_function("rb_or", "rb_or_null2empty")
def _or(*args: str) -> str:
    return _fold(args, lambda a, b: f"array_union({a}, {b})")


@sql_function("rb_xor", "rb_xor_null2empty")
def _rb_xor(*args: str) -> str:
    return _fold(args, _xor)


simple("rb_andnot", "array_sort(array_except({0}, {1}))")
simple("rb_andnot_null2empty", "array_sort(array_except({0}, {1}))")
simple("rb_cardinality", "CAST(coalesce(cardinality({0}), 0) AS BIGINT)")
simple("rb_empty", "(cardinality({0}) = 0)")
simple("rb_equals", "(array_sort({0}) = array_sort({1}))")
simple("rb_not_equals", "(array_sort({0}) <> array_sort({1}))")
simple("rb_intersect", "arrays_overlap({0}, {1})")


@sql_function("rb_contains")
def _contains(b: str, *args: str) -> str:
    return "(" + " AND ".join(f"array_contains({b}, {bigint(a)})" for a in args) + ")"


@sql_function("rb_contains_range")
def _contains_range(b: str, lo: str, hi: str) -> str:
    return f"(size(filter({b}, x -> x >= {bigint(lo)} AND x < {bigint(hi)})) = greatest({bigint(hi)} - {bigint(lo)}, 0))"


@sql_function("rb_add")
def _add(b: str, *args: str) -> str:
    return f"array_sort(array_union({b}, {values(*args)}))"


@sql_function("rb_add_range")
def _add_range(b: str, lo: str, hi: str) -> str:
    return f"array_sort(array_union({b}, {_range(lo, hi)}))"


@sql_function("rb_remove")
def _remove(b: str, *args: str) -> str:
    return f"array_sort(array_except({b}, {values(*args)}))"


@sql_function("rb_remove_range")
def _remove_range(b: str, lo: str, hi: str) -> str:
    return f"filter({b}, x -> x < {bigint(lo)} OR x >= {bigint(hi)})"


@sql_function("rb_flip")
def _flip(b: str, *args: str) -> str:
    return f"array_sort({_xor(b, values(*args))})"


@sql_function("rb_flip_range")
def _flip_range(b: str, lo: str, hi: str) -> str:
    return f"array_sort({_xor(b, _range(lo, hi))})"


simple("rb_minimum", "coalesce(array_min({0}), 0L)")
simple("rb_maximum", "coalesce(array_max({0}), 0L)")


@sql_function("rb_rank")
def _rank(b: str, v: str) -> str:
    return f"CAST(size(filter({b}, x -> x <= {bigint(v)})) AS BIGINT)"


@sql_function("rb_jaccard_index")
def _jaccard(a: str, b: str) -> str:
    return f"try_divide(CAST(size(array_intersect({a}, {b})) AS DOUBLE), CAST(size(array_union({a}, {b})) AS DOUBLE))"
