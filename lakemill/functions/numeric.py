"""Mathematical functions."""

from __future__ import annotations

from lakemill.functions.registry import bits, double, none_null, simple, sql_function

D0, D1 = double("{0}"), double("{1}")


@sql_function("round")
def _round(x: str, d: str = "0") -> str:
    """Half away from zero on doubles; digits beyond what a double holds change nothing, far before the point give 0."""
    d = d.strip()
    if d.lstrip("-").isdigit():
        n = int(d)
        if n > 18:
            return double(x)
        if n < -300:
            return f"({double(x)} * 0D)"
        return f"round({double(x)}, {n})"
    scale = f"CAST(least(greatest({d}, -300), 18) AS INT)"
    return f"(sign({double(x)}) * floor(abs({double(x)}) * power(10D, {scale}) + 0.5D) / power(10D, {scale}))"


simple("floor", f"CAST(floor({D0}) AS BIGINT)")
simple("ceil", f"CAST(ceil({D0}) AS BIGINT)")
simple("ceiling", f"CAST(ceil({D0}) AS BIGINT)")
simple("abs", f"abs({D0})")
simple("sqrt", f"CASE WHEN {D0} >= 0 THEN sqrt({D0}) END")
simple("mod", f"try_mod({D0}, {D1})")
simple("sign", f"CAST(signum({D0}) AS BIGINT)")
simple("sin", f"sin({D0})")
simple("asin", f"CASE WHEN abs({D0}) <= 1 THEN asin({D0}) END")
simple("cos", f"cos({D0})")
simple("acos", f"CASE WHEN abs({D0}) <= 1 THEN acos({D0}) END")
simple("tan", f"tan({D0})")
simple("cot", f"CASE WHEN sin({D0}) <> 0 THEN cos({D0}) / sin({D0}) END")
simple("atan", f"atan({D0})")
simple("ln", f"CASE WHEN {D0} > 0 THEN ln({D0}) END")
simple("log", f"CASE WHEN {D0} > 0 AND {D1} > 0 AND {D0} <> 1 THEN ln({D1}) / ln({D0}) END")
simple("pi", "pi()")
simple("pow", f"power({D0}, {D1})")
simple("power", f"power({D0}, {D1})")
simple("bit_count", f"CAST(bit_count({bits('{0}')}) AS BIGINT)")


@sql_function("rand")
def _rand(*_: str) -> str:
    """A seed is accepted and ignored."""
    return "rand()"


@sql_function("greatest")
def _greatest(*args: str) -> str:
    return none_null(args, f"greatest({', '.join(map(double, args))})" if len(args) > 1 else double(args[0]))


@sql_function("least")
def _least(*args: str) -> str:
    return none_null(args, f"least({', '.join(map(double, args))})" if len(args) > 1 else double(args[0]))
