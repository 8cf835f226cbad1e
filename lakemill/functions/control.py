"""Conditional, hash, session and geographic functions, and casts."""

from __future__ import annotations

from lakemill.functions.registry import bigint, double, none_null, simple, sql_function, text
from lakemill.functions.temporal import clock, date, datetime, seconds

simple("if", "CASE WHEN {0} THEN {1} ELSE {2} END")
simple("ifnull", "coalesce({0}, {1})")
simple("nullif", "nullif({0}, {1})")
simple("isnull", "(({0}) IS NULL)")
simple("md5", f"md5(CAST({text('{0}')} AS BINARY))")
simple("sha", f"sha1(CAST({text('{0}')} AS BINARY))")
simple("sha1", f"sha1(CAST({text('{0}')} AS BINARY))")
simple("version", "version()")
simple("database", "current_database()")
for _n in ("user", "session_user", "system_user", "current_user"):
    simple(_n, "current_user()")
#: Mean radius of the earth in kilometres (fixed value).
_RADIUS = 6378.138


@sql_function("case_when")
def _case_when(*args: str) -> str:
    """Conditions and values in turn, then perhaps a value for none."""
    whens = " ".join(f"WHEN {c} THEN {v}" for c, v in zip(args[::2], args[1::2], strict=False))
    return f"CASE {whens}{f' ELSE {args[-1]}' if len(args) % 2 else ''} END"


@sql_function("case_expr_when")
def _case_expr_when(x: str, *args: str) -> str:
    return f"CASE {x}" + _case_when(*args)[4:]


@sql_function("murmur_hash")
def _murmur_hash(x: str) -> str:
    """A 64-bit hash; xxHash64, whose values differ from other engines' Murmur signatures."""
    return f"xxhash64({text(x)})"


@sql_function("last_insert_id")
def _last_insert_id(n: str = "0") -> str:
    return bigint(n)


@sql_function("point_distance")
def _point_distance(a: str, b: str, c: str, d: str) -> str:
    """Great-circle distance in whole metres."""
    a, b, c, d = (f"radians({double(x)})" for x in (a, b, c, d))
    half = f"power(sin(({a} - {c}) / 2), 2) + cos({a}) * cos({c}) * power(sin(({b} - {d}) / 2), 2)"
    return f"CAST(round(2 * asin(sqrt({half})) * {_RADIUS}D * 1000) AS BIGINT)"


def signed(x: str) -> str:
    """The leading number of a text, 0 without one; other values are cast."""
    s = text(x)
    number = f"regexp_extract({s}, '^\\\\s*([+-]?[0-9]+)', 1)"
    return none_null([x], f"coalesce(try_cast(nullif({number}, '') AS BIGINT), 0L)")


def number(x: str) -> str:
    """The leading number of a text as double, 0 without one."""
    found = f"regexp_extract({text(x)}, '^\\\\s*([+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?)', 1)"
    return none_null([x], f"coalesce(try_cast(nullif({found}, '') AS DOUBLE), 0D)")


simple("cast_to_string", text("{0}"))


@sql_function("cast_to_date")
def _to_date(x: str) -> str:
    return date(x)


@sql_function("cast_to_datetime")
def _to_datetime(x: str) -> str:
    return f"date_trunc('SECOND', {datetime(x)})"


@sql_function("cast_to_time")
def _to_time(x: str) -> str:
    return clock(seconds(x))


sql_function("cast_to_signed")(signed)
sql_function("cast_to_double")(number)


@sql_function("cast_to_unsigned")
def _to_unsigned(x: str) -> str:
    """Negative numbers wrap around at 2 to the 64."""
    n = f"coalesce(try_cast(nullif(regexp_extract({text(x)}, '^\\\\s*([+-]?[0-9]+)', 1), '') AS DECIMAL(20,0)), 0)"
    return none_null([x], f"CAST(CASE WHEN {n} < 0 THEN {n} + 18446744073709551616 ELSE {n} END AS DECIMAL(20,0))")
