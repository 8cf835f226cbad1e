"""Date and time functions.

Datetimes are TIMESTAMP_NTZ; text is read leniently (any delimiter, two-digit
years, compact digits, missing parts).  A TIME is text ``[-]HH:MM:SS`` and may
exceed a day.  Functions of the current instant and of epoch seconds use the
session's time zone.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import datetime as datetime_of

from lakemill.functions.registry import FUNCTIONS, bigint, none_null, sql_function, text, unquoted

_DELIMITED = r"^\\s*([0-9]{4}|[0-9]{2})[^0-9]+([0-9]{1,2})[^0-9]+([0-9]{1,2})(?:[^0-9]+([0-9]{1,2})(?:[^0-9]([0-9]{1,2})(?:[^0-9]([0-9]{1,2})(?:[.]([0-9]{1,6})[0-9]*)?)?)?)?.*$"
_COMPACT = r"^\\s*([0-9]{4}|[0-9]{2})([0-9]{2})([0-9]{2})(?:([0-9]{2})([0-9]{2})([0-9]{2}))?\\s*$"
_TIME = r"^\\s*(-?)([0-9]+):([0-9]{1,2})(?::([0-9]{1,2}))?(?:[.][0-9]*)?\\s*$"
_EPOCH_DAYS = 719_528
_PLAIN = re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2}( [0-9]{2}:[0-9]{2}:[0-9]{2})?")


def _read(x: str) -> str:
    """A literal that is plainly a datetime is read here, not for each row."""
    plain = unquoted(x)
    if plain is None or not _PLAIN.fullmatch(plain):
        return x
    try:
        return f"TIMESTAMP_NTZ'{datetime_of.fromisoformat(plain)}'"
    except ValueError:
        return x


def simple(name: str, template: str) -> None:
    """Like the registry's, for templates that hold braces of patterns."""

    def build(*args: str) -> str:
        out, args = template, tuple(map(_read, args))
        for i, a in enumerate(args):
            out = out.replace(f"{{{i}}}", f"\0{i}\0")
        for i, a in enumerate(args):
            out = out.replace(f"\0{i}\0", a)
        return out

    FUNCTIONS[name] = build


def _piece(s: str, pattern: str, group: int) -> str:
    return f"coalesce(try_cast(nullif(regexp_extract({s}, '{pattern}', {group}), '') AS INT), 0)"


def _built(s: str, pattern: str, fraction: bool) -> str:
    y, mo, d, h, mi, sec = (_piece(s, pattern, k) for k in range(1, 7))
    year = f"({y} + CASE WHEN length(regexp_extract({s}, '{pattern}', 1)) = 4 THEN 0 WHEN {y} >= 70 THEN 1900 ELSE 2000 END)"
    seconds = f"CAST({sec} AS DECIMAL(16,6))"
    if fraction:
        seconds = f"({seconds} + try_cast(concat('0.', coalesce(nullif(regexp_extract({s}, '{pattern}', 7), ''), '0')) AS DECIMAL(16,6)))"
    return f"CASE WHEN {s} RLIKE '{pattern}' THEN try_make_timestamp_ntz({year}, {mo}, {d}, {h}, {mi}, {seconds}) END"


def bound(x: str, body: Callable[[str], str]) -> str:
    """``body`` of a name that stands for ``x``, so that a long expression is written and computed once."""
    return f"get(transform(array({x}), v -> {body('v')}), 0)"


def datetime(x: str) -> str:
    """Any value as TIMESTAMP_NTZ, null if it cannot be read.

    The type test folds at planning, so that a date or timestamp column costs a
    cast at most.  Number columns are read after a cast to CHAR.
    """
    if re.fullmatch(r"\d+", x.strip()):
        x = f"'{x.strip()}'"
    x = _read(x)
    read = lambda s: f"coalesce(CASE WHEN {s} LIKE '____-__-__%' THEN try_cast({s} AS TIMESTAMP_NTZ) END, {_built(s, _DELIMITED, True)}, {_built(s, _COMPACT, False)})"
    return f"CASE WHEN typeof({x}) IN ('timestamp_ntz', 'timestamp', 'date') THEN try_cast({x} AS TIMESTAMP_NTZ) ELSE {bound(text(x), read)} END"


def date(x: str) -> str:
    return f"CAST({datetime(x)} AS DATE)"


def seconds(x: str) -> str:
    """A TIME, or the time of day of a datetime, as signed seconds."""
    parts = [f"CAST(nullif(regexp_extract(v, '{_TIME}', {k}), '') AS BIGINT)" for k in (2, 3, 4)]
    total = f"({parts[0]} * 3600 + {parts[1]} * 60 + coalesce({parts[2]}, 0))"
    of_time = bound(text(x), lambda v: f"CASE WHEN regexp_extract({v}, '{_TIME}', 1) = '-' THEN -{total} ELSE {total} END")
    of_day = bound(datetime(x), lambda v: f"CAST(hour({v}) * 3600 + minute({v}) * 60 + floor(second({v})) AS BIGINT)")
    t = f"try_cast({x} AS TIMESTAMP_NTZ)"
    direct = f"CAST(hour({t}) * 3600 + minute({t}) * 60 + floor(second({t})) AS BIGINT)"
    return f"CASE WHEN typeof({x}) IN ('timestamp_ntz', 'timestamp', 'date') THEN {direct} WHEN {text(x)} RLIKE '{_TIME}' THEN {of_time} ELSE {of_day} END"


def clock(n: str) -> str:
    """Signed seconds as TIME text."""
    return bound(n, _clock)


def _clock(n: str) -> str:
    a = f"abs({n})"
    return f"concat(CASE WHEN {n} < 0 THEN '-' ELSE '' END, CASE WHEN {a} < 36000 THEN '0' ELSE '' END, CAST({a} DIV 3600 AS STRING), ':', lpad(CAST({a} DIV 60 % 60 AS STRING), 2, '0'), ':', lpad(CAST({a} % 60 AS STRING), 2, '0'))"


T0, T1 = datetime("{0}"), datetime("{1}")
_NOW = "localtimestamp()"
_UTC = "convert_timezone('UTC', localtimestamp())"


@sql_function("now", "sysdate", "current_timestamp", "localtime", "localtimestamp")
def _now(*_: str) -> str:
    return f"date_trunc('SECOND', {_NOW})"


simple("utc_timestamp", f"date_trunc('SECOND', {_UTC})")
simple("utc_date", f"CAST({_UTC} AS DATE)")
simple("utc_time", clock(seconds(f"date_trunc('SECOND', {_UTC})")))
for _n in ("curdate", "current_date"):
    simple(_n, "current_date()")
for _n in ("curtime", "current_time"):
    simple(_n, clock(seconds(f"date_trunc('SECOND', {_NOW})")))


@sql_function("unix_timestamp")
def _unix_timestamp(t: str | None = None) -> str:
    return "unix_timestamp()" if t is None else f"unix_timestamp(CAST({datetime(t)} AS TIMESTAMP))"


simple("from_unixtime", f"CAST(timestamp_seconds({bigint('{0}')}) AS TIMESTAMP_NTZ)")
simple("minute", f"CAST(abs({seconds('{0}')}) DIV 60 % 60 AS INT)")
simple("second", f"CAST(abs({seconds('{0}')}) % 60 AS INT)")
simple("hour", f"CAST(abs({seconds('{0}')}) DIV 3600 AS INT)")
simple("time", clock(seconds("{0}")))
simple("quarter", f"quarter({T0})")
simple("microsecond", f"CAST(coalesce(try_cast(nullif(regexp_extract({text('{0}')}, '[.]([0-9]{{1,6}})$', 1), '') AS INT), 0) AS INT)")
for _n, _f in {"year": "year", "month": "month", "day": "day", "dayofmonth": "day", "dayofweek": "dayofweek", "dayofyear": "dayofyear", "weekday": "weekday", "weekofyear": "weekofyear"}.items():
    simple(_n, f"{_f}({T0})")
simple("dayname", f"date_format({T0}, 'EEEE')")
simple("monthname", f"date_format({T0}, 'MMMM')")
simple("date", date("{0}"))
simple("datediff", f"datediff({date('{0}')}, {date('{1}')})")
simple("to_days", f"CAST(datediff({date('{0}')}, DATE'1970-01-01') + {_EPOCH_DAYS} AS BIGINT)")
simple("to_seconds", f"(timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {T0}) + {_EPOCH_DAYS} * 86400L)")
simple("time_to_sec", seconds("{0}"))
simple("sec_to_time", clock(bigint("{0}")))
simple("timediff", clock(f"CASE WHEN {text('{0}')} RLIKE '{_TIME}' THEN {seconds('{0}')} - ({seconds('{1}')}) ELSE timestampdiff(SECOND, {T1}, {T0}) END"))
simple("str_to_date", T0)


@sql_function("timestamp")
def _timestamp(t: str, time: str | None = None) -> str:
    return datetime(t) if time is None else f"timestampadd(SECOND, {seconds(time)}, {datetime(t)})"


@sql_function("addtime")
def _addtime(t: str, d: str, sign: str = "") -> str:
    moved = f"timestampadd(SECOND, {sign}({seconds(d)}), {datetime(t)})"
    return f"CASE WHEN {text(t)} RLIKE '{_TIME}' THEN {clock(f'({seconds(t)} + {sign}({seconds(d)}))')} ELSE date_format({moved}, 'yyyy-MM-dd HH:mm:ss') END"


@sql_function("subtime")
def _subtime(t: str, d: str) -> str:
    return _addtime(t, d, "-")


_UNITS = ("SECOND", "MINUTE", "HOUR", "DAY")


@sql_function("timestampadd")
def _timestampadd(unit: str, n: str, t: str) -> str:
    return f"timestampadd({unit.upper()}, CAST({n} AS INT), {datetime(t)})" if unit.upper() in _UNITS else "CAST(NULL AS TIMESTAMP_NTZ)"


@sql_function("timestampdiff")
def _timestampdiff(unit: str, a: str, b: str) -> str:
    return f"timestampdiff({unit.upper()}, {datetime(a)}, {datetime(b)})" if unit.upper() in _UNITS else "CAST(NULL AS BIGINT)"


def shifted(t: str, n: str, unit: str = "DAY", sign: str = "") -> str:
    """``t`` plus ``n`` units; units other than second to year give null."""
    if unit.upper() not in (*_UNITS, "MONTH", "YEAR"):
        return "CAST(NULL AS TIMESTAMP_NTZ)"
    return f"timestampadd({unit.upper()}, {sign}CAST({n} AS INT), {datetime(t)})"


@sql_function("date_add", "adddate")
def _date_add(t: str, n: str, unit: str = "DAY") -> str:
    return shifted(t, n, unit)


@sql_function("date_sub", "subdate")
def _date_sub(t: str, n: str, unit: str = "DAY") -> str:
    return shifted(t, n, unit, "-")


@sql_function("extract")
def _extract(unit: str, t: str) -> str:
    if unit.upper() not in ("YEAR", "MONTH", "DAY", "HOUR", "MINUTE", "SECOND"):
        return "CAST(NULL AS INT)"
    return f"CAST(extract({unit.upper()} FROM {datetime(t)}) AS INT)"


@sql_function("period_diff")
def _period_diff(a: str, b: str) -> str:
    months = lambda p: f"(({bigint(p)} DIV 100) * 12 + {bigint(p)} % 100)"
    return f"CAST({months(a)} - {months(b)} AS INT)"


@sql_function("period_add")
def _period_add(p: str, n: str) -> str:
    total = f"(({bigint(p)} DIV 100) * 12 + {bigint(p)} % 100 - 1 + {bigint(n)})"
    return f"CAST(({total} DIV 12) * 100 + {total} % 12 + 1 AS STRING)"


@sql_function("convert_tz")
def _convert_tz(t: str, a: str, b: str) -> str:
    """Offsets ``+HH:MM`` and SYSTEM only, else null."""
    ok = lambda z: f"(upper({z}) = 'SYSTEM' OR {z} RLIKE '^[+-][0-9]{{2}}:[0-9]{{2}}$')"
    offset = lambda z: f"CASE WHEN upper({z}) = 'SYSTEM' THEN current_timezone() WHEN {ok(z)} THEN {z} ELSE 'UTC' END"
    return f"CASE WHEN {ok(a)} AND {ok(b)} THEN date_format(convert_timezone({offset(a)}, {offset(b)}, {datetime(t)}), 'yyyy-MM-dd HH:mm:ss') END"


#: Bits of a timestamp-oracle value below its milliseconds.
_LOGICAL_BITS = 18
simple("tso_to_timestamp", f"CAST(timestamp_millis(shiftright({bigint('{0}')}, {_LOGICAL_BITS})) AS TIMESTAMP_NTZ)")
simple("timestamp_to_tso", f"shiftleft(unix_millis(CAST({T0} AS TIMESTAMP)), {_LOGICAL_BITS})")


def _week_parts(d: str, mode: int) -> tuple[str, str, str, str]:
    """Year, and first days of week 1 of the last, this and the next year.

    Week 1 is the week that holds 4 January if it needs four days in the year,
    the one that holds 7 January if it needs its first day there.
    """
    monday = mode % 2 == 1
    needs_first_day = mode in (0, 2, 5, 7)
    mark = "07" if needs_first_day else "04"
    back = "weekday({0})" if monday else "dayofweek({0}) - 1"

    def start(shift: int) -> str:
        k = f"make_date(year({d}) + {shift}, 1, {int(mark)})"
        return f"date_sub({k}, {back.format(k)})"

    return f"year({d})", start(-1), start(0), start(1)


def week_number(d: str, mode: int) -> str:
    _, before, this, after = _week_parts(d, mode)
    count = lambda s: f"CAST(floor(datediff({d}, {s}) / 7) + 1 AS INT)"
    if mode in (0, 1, 4, 5):
        return f"CASE WHEN {d} < {this} THEN 0 ELSE {count(this)} END"
    return f"CASE WHEN {d} < {this} THEN {count(before)} WHEN {d} >= {after} THEN 1 ELSE {count(this)} END"


def year_week(d: str, mode: int) -> str:
    year, before, this, after = _week_parts(d, mode)
    count = lambda s: f"CAST(floor(datediff({d}, {s}) / 7) + 1 AS INT)"
    return f"CASE WHEN {d} < {this} THEN ({year} - 1) * 100 + {count(before)} WHEN {d} >= {after} THEN ({year} + 1) * 100 + 1 ELSE {year} * 100 + {count(this)} END"


def _by_mode(f):
    def build(t: str, mode: str = "0") -> str:
        if mode.strip().isdigit():
            return bound(date(t), lambda d: f(d, int(mode) % 8))
        return bound(date(t), lambda d: f"CASE CAST({mode} AS INT) % 8 {' '.join(f'WHEN {m} THEN {f(d, m)}' for m in range(8))} END")

    return build


sql_function("week")(_by_mode(week_number))
sql_function("yearweek")(_by_mode(year_week))

#: Format letters and the patterns that print them (fixed values).
_PATTERNS = {"Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "S": "ss", "s": "ss", "j": "DDD", "a": "EEE", "b": "MMM", "T": "HH:mm:ss", "c": "M", "e": "d", "k": "H", "l": "h", "h": "hh", "I": "hh", "i": "mm", "M": "MMMM", "W": "EEEE", "p": "a", "r": "hh:mm:ss a", "X": "yyyy", "x": "yyyy"}


def _formatted(t: str, letter: str) -> str:
    d = f"CAST({t} AS DATE)"
    if letter in _PATTERNS:
        return f"date_format({t}, '{_PATTERNS[letter]}')"
    if letter == "D":
        day = f"day({t})"
        return f"concat({day}, CASE WHEN {day} BETWEEN 11 AND 13 THEN 'th' WHEN {day} % 10 = 1 THEN 'st' WHEN {day} % 10 = 2 THEN 'nd' WHEN {day} % 10 = 3 THEN 'rd' ELSE 'th' END)"
    if letter == "f":
        return "'000000'"
    if letter == "u":
        return f"lpad(CAST({week_number(d, 5)} AS STRING), 2, '0')"
    if letter == "U":
        return f"lpad(CAST({week_number(d, 0)} AS STRING), 2, '0')"
    if letter in "vV":
        return f"lpad(CAST(weekofyear({t}) AS STRING), 2, '0')"
    if letter == "w":
        return f"CAST(dayofweek({t}) - 1 AS STRING)"
    return "'" + letter.replace("\\", "\\\\").replace("'", "\\'") + "'"


@sql_function("date_format")
def _date_format(t: str, fmt: str) -> str:
    """The format must be a literal; it is read once and becomes one concatenation."""
    return bound(datetime(t), lambda v: _format(v, fmt))


def _format(t: str, fmt: str) -> str:
    spec = unquoted(fmt)
    if spec is None:
        raise ValueError("date_format needs a literal format")
    parts, i, plain = [], 0, ""
    spec = spec.replace("\\%", "%")
    while i < len(spec):
        if spec[i] == "%" and i + 1 < len(spec):
            if plain:
                parts.append("'" + plain.replace("\\", "\\\\").replace("'", "\\'") + "'")
                plain = ""
            parts.append(_formatted(t, spec[i + 1]))
            i += 2
        else:
            plain += spec[i]
            i += 1
    if plain:
        parts.append("'" + plain.replace("\\", "\\\\").replace("'", "\\'") + "'")
    return none_null([t], f"concat({', '.join(parts)})") if parts else none_null([t], "''")


@sql_function("time_format")
def _time_format(t: str, fmt: str) -> str:
    return bound(f"timestampadd(SECOND, {seconds(t)}, TIMESTAMP_NTZ'1970-01-01 00:00:00')", lambda v: _format(v, fmt))
