"""The function library: each function builds a Spark SQL expression from the SQL of its arguments.

One definition serves both ways in: the dialect (``lakemill.plans.dialect``)
calls it for functions found in a statement, and :func:`call` makes a Column.
All expressions are built from Spark's own functions, so Catalyst can fold, push
down and compile them.  None of them depends on the ANSI setting.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Builder = Callable[..., str]
FUNCTIONS: dict[str, Builder] = {}


def sql_function(*names: str) -> Callable[[Builder], Builder]:
    def register(f: Builder) -> Builder:
        for n in names:
            FUNCTIONS[n] = f
        return f

    return register


def simple(name: str, template: str, *defaults: str) -> None:
    """Register ``template`` with {0}, {1}, ... for the arguments; missing last ones take ``defaults``."""

    def build(*args: str) -> str:
        need = 1 + max((i for i in range(9) if f"{{{i}}}" in template), default=-1)
        filled = [*args, *defaults[len(defaults) - (need - len(args)) :]] if need > len(args) else list(args)
        return template.format(*filled)

    FUNCTIONS[name] = build


def double(x: str) -> str:
    return f"try_cast({x} AS DOUBLE)"


def bigint(x: str) -> str:
    return f"try_cast({x} AS BIGINT)"


#: The type of unsigned 64-bit values.
UNSIGNED = "DECIMAL(20,0)"


def bits(x: str) -> str:
    """A signed or unsigned 64-bit value as BIGINT with the same bits."""
    return f"coalesce({bigint(x)}, CAST(try_cast({x} AS {UNSIGNED}) - 18446744073709551616 AS BIGINT))"


def unsigned(x: str) -> str:
    """The bits of a BIGINT as a number from 0."""
    return f"CAST(CAST({x} AS {UNSIGNED}) + CASE WHEN {x} < 0 THEN 18446744073709551616 ELSE 0 END AS {UNSIGNED})"


def text(x: str) -> str:
    return f"CAST({x} AS STRING)"


def none_null(args: tuple[str, ...] | list[str], value: str) -> str:
    """``value`` unless an argument is null."""
    return f"CASE WHEN {' AND '.join(f'({a}) IS NOT NULL' for a in args)} THEN {value} END"


def literal(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, (int, float)):
        return repr(value)
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def unquoted(sql: str) -> str | None:
    """The value of a string literal's SQL, None for any other expression."""
    s = sql.strip()
    if len(s) < 2 or s[0] != s[-1] or s[0] not in "'\"":
        return None
    out, i = [], 1
    escapes = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", "b": "\b", "Z": "\x1a"}
    while i < len(s) - 1:
        if s[i] == "\\" and i + 1 < len(s) - 1:
            c = s[i + 1]
            out.append("\\" + c if c in "%_" else escapes.get(c, c))
            i += 2
        elif s[i] == s[0] and s[i + 1] == s[0] and i + 1 < len(s) - 1:
            out.append(s[0])
            i += 2
        elif s[i] == s[0]:
            return None
        else:
            out.append(s[i])
            i += 1
    return "".join(out)


def build(name: str, *args: str) -> str:
    """The SQL of a library function; KeyError for an unknown name."""
    return FUNCTIONS[name.lower()](*args)


def call(name: str, *args: object) -> Column:
    """A Column from a library function.

    Strings are SQL expressions (column names among them); other values are
    literals.  For string literals use :func:`literal`.
    """
    return F.expr(build(name, *[a if isinstance(a, str) else literal(a) for a in args]))
