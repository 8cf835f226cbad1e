"""String and JSON functions.

Positions and lengths count characters, except ``length`` and ``bit_length``,
which count bytes.
"""

from __future__ import annotations

from lakemill.functions.registry import bigint, none_null, simple, sql_function, text, unquoted

S0, S1, S2 = text("{0}"), text("{1}"), text("{2}")
N0, N1 = bigint("{0}"), bigint("{1}")
INT_MAX = 2_147_483_647

simple("length", f"CAST(octet_length({S0}) AS BIGINT)")
simple("bit_length", f"CAST(bit_length({S0}) AS BIGINT)")
for _name in ("upper", "ucase"):
    simple(_name, f"upper({S0})")
for _name in ("lower", "lcase", "lower_gbk"):
    simple(_name, f"lower({S0})")
simple("left", f"CASE WHEN {N1} <= 0 THEN '' ELSE left({S0}, CAST(least({N1}, {INT_MAX}) AS INT)) END")
simple("right", f"CASE WHEN {N1} <= 0 THEN '' ELSE right({S0}, CAST(least({N1}, {INT_MAX}) AS INT)) END")
simple("trim", f"coalesce(trim({S0}), '')")
simple("ltrim", f"coalesce(ltrim({S0}), '')")
simple("rtrim", f"coalesce(rtrim({S0}), '')")
simple("ascii", f"CASE WHEN {S0} = '' THEN 0 ELSE CAST(conv(substr(hex({S0}), 1, 2), 16, 10) AS INT) END")
simple("strcmp", "CASE WHEN {0} < {1} THEN -1 WHEN {0} > {1} THEN 1 WHEN {0} = {1} THEN 0 END")
simple("insert", f"CASE WHEN {{1}} < 1 OR {{2}} <= 0 OR {{1}} > char_length({S0}) THEN {S0} ELSE overlay({S0} PLACING {text('{3}')} FROM CAST({{1}} AS INT) FOR CAST({{2}} AS INT)) END")
simple("replace", f"CASE WHEN {S1} = '' THEN {S0} ELSE replace({S0}, {S1}, {S2}) END")
simple("repeat", f"CASE WHEN {N1} > 0 THEN repeat({S0}, CAST({N1} AS INT)) END")
simple("reverse", f"reverse({S0})")
simple("locate", f"locate({S0}, {S1}, CAST({{2}} AS INT))", "1")
simple("instr", f"instr({S0}, {S1})")
simple("position", f"locate({S0}, {S1})")
simple("split_part", f"CASE WHEN {{2}} > 0 THEN split_part({S0}, {S1}, CAST(greatest({{2}}, 1) AS INT)) END")
simple("to_base64", f"replace(replace(base64(CAST({S0} AS BINARY)), chr(13), ''), chr(10), '')")
simple("from_base64", f"CAST(unbase64({S0}) AS STRING)")
simple("oct", f"conv({text(N0)}, 10, 8)")
simple("hex", "hex({0})")
simple("unhex", f"CAST(unhex(CASE WHEN octet_length({S0}) % 2 = 1 THEN concat('0', {S0}) ELSE {S0} END) AS STRING)")
simple("bin", f"bin({N0})")
simple("space", f"CASE WHEN {N0} BETWEEN 1 AND 1000000 THEN repeat(' ', CAST({N0} AS INT)) END")
simple("char_length", f"char_length({S0})")
simple("character_length", f"char_length({S0})")
simple("format", "format_number(CAST({0} AS DOUBLE), CAST({1} AS INT))")
simple("quote", f"concat(chr(39), replace(replace({S0}, chr(92), concat(chr(92), chr(92))), chr(39), concat(chr(92), chr(39))), chr(39))")
simple("find_in_set", f"CAST(find_in_set({S0}, {S1}) AS BIGINT)")


@sql_function("concat")
def _concat(*args: str) -> str:
    return f"concat({', '.join(map(text, args))})"


@sql_function("concat_ws")
def _concat_ws(sep: str, *args: str) -> str:
    if not args:
        return "CAST(NULL AS STRING)"
    return f"CASE WHEN coalesce({', '.join(map(text, args))}) IS NOT NULL THEN concat_ws({sep}, {', '.join(map(text, args))}) END"


@sql_function("substr", "substring", "mid")
def _substr(s: str, pos: str, size: str | None = None) -> str:
    s, n = text(s), f"char_length({text(s)})"
    body = f"substr({s}, CAST({pos} AS INT))" if size is None else f"substr({s}, CAST({pos} AS INT), CAST({size} AS INT))"
    bad = f"{pos} = 0 OR abs({pos}) > {n}" + ("" if size is None else f" OR {size} <= 0")
    args = [s, pos] if size is None else [s, pos, size]
    return none_null(args, f"(CASE WHEN {bad} THEN '' ELSE {body} END)")


@sql_function("substring_index")
def _substring_index(s: str, d: str, n: str) -> str:
    """Delimiters are found from the left and do not overlap, also when the end is asked for."""
    parts = f"split({text(s)}, concat('\\\\Q', {text(d)}, '\\\\E'), -1)"
    taken = f"CASE WHEN {n} > 0 THEN slice({parts}, 1, CAST(greatest({n}, 1) AS INT)) WHEN size({parts}) <= -({n}) THEN {parts} ELSE slice({parts}, CAST(size({parts}) + least({n}, -1) + 1 AS INT), CAST(greatest(-({n}), 1) AS INT)) END"
    return none_null([s, d, n], f"(CASE WHEN {n} = 0 OR {text(d)} = '' THEN '' ELSE array_join({taken}, {text(d)}) END)")


def _pad(kind: str):
    def build(s: str, n: str, p: str) -> str:
        body = f"CASE WHEN {n} <= 0 OR {n} > 65535 THEN NULL WHEN {n} <= char_length({text(s)}) THEN left({text(s)}, CAST({n} AS INT)) WHEN {text(p)} = '' THEN NULL ELSE {kind}({text(s)}, CAST({n} AS INT), {text(p)}) END"
        return none_null([s, n, p], f"({body})")

    return build


sql_function("lpad")(_pad("lpad"))
sql_function("rpad")(_pad("rpad"))


@sql_function("regexp_replace")
def _regexp_replace(s: str, p: str, r: str, pos: str = "1", occurrence: str = "0", mode: str = "''") -> str:
    flags = {"i": "i", "n": "s", "m": "m"}
    chosen = "".join(flags.get(c, "") for c in (unquoted(mode) or ""))
    pattern = f"concat('(?{chosen})', {text(p)})" if chosen else text(p)
    if occurrence.strip() == "0":
        if pos.strip() == "1":
            return f"regexp_replace({text(s)}, {pattern}, {text(r)})"
        return f"regexp_replace({text(s)}, {pattern}, {text(r)}, CAST({pos} AS INT))"
    # The n-th match: the text before it, its replacement, the rest.
    head, tail = f"substr({text(s)}, 1, CAST({pos} AS INT) - 1)", f"substr({text(s)}, CAST({pos} AS INT))"
    found = f"regexp_extract_all({tail}, concat('(?s)(', {pattern}, ')'), 1)"
    gaps = f"split({tail}, {pattern}, -1)"
    nth = f"CAST({occurrence} AS INT)"
    return none_null([s, p, r], f"(CASE WHEN size({found}) < {nth} THEN {text(s)} ELSE concat({head}, array_join(transform({gaps}, (g, i) -> concat(g, CASE WHEN i + 1 = {nth} THEN regexp_replace({found}[i], {pattern}, {text(r)}) ELSE coalesce(get({found}, i), '') END)), '')) END)")


@sql_function("export_set")
def _export_set(bits: str, on: str, off: str, sep: str, n: str = "64") -> str:
    count = f"(CASE WHEN {n} BETWEEN 1 AND 64 THEN CAST({n} AS INT) ELSE 64 END)"
    return f"array_join(transform(sequence(0, {count} - 1), i -> CASE WHEN getbit({bigint(bits)}, i) = 1 THEN {text(on)} ELSE {text(off)} END), {text(sep)})"


@sql_function("make_set")
def _make_set(bits: str, *args: str) -> str:
    picked = ", ".join(f"CASE WHEN getbit({bigint(bits)}, {i}) = 1 THEN {text(a)} END" for i, a in enumerate(args))
    return none_null([bits, *args], f"concat_ws(',', {picked})")


@sql_function("elt")
def _elt(n: str, *args: str) -> str:
    cases = " ".join(f"WHEN {i} THEN {text(a)}" for i, a in enumerate(args, 1))
    return none_null([n, *args], f"(CASE CAST({n} AS INT) {cases} END)")


@sql_function("field")
def _field(s: str, *args: str) -> str:
    cases = " ".join(f"WHEN {text(s)} = {text(a)} THEN {i}" for i, a in enumerate(args, 1))
    return none_null([s, *args], f"(CASE {cases} ELSE 0 END)")


@sql_function("char")
def _char(*args: str) -> str:
    """Each number as big-endian bytes without leading zeros; one number 0 is one zero byte."""
    parts = [f"hex({bigint(a)})" for a in args]
    even = [f"CASE WHEN length({p}) % 2 = 1 THEN concat('0', {p}) ELSE {p} END" for p in parts]
    return none_null(args, f"CAST(unhex(concat({', '.join(even)})) AS STRING)")


@sql_function("soundex")
def _soundex(s: str) -> str:
    """Letter and up to three digits; vowels do not separate equal digits and the first letter's digit does not count."""
    letters = f"upper(regexp_replace({text(s)}, '[^A-Za-z]', ''))"
    codes = f"regexp_replace(translate(substr({letters}, 2), 'BFPVCGJKQSXZDTLMNRAEIOUHWY', '11112222222233455600000000'), '0', '')"
    once = f"regexp_replace({codes}, '([1-6])\\\\1+', '$1')"
    return f"CASE WHEN {letters} = '' THEN '' WHEN {text(s)} IS NOT NULL THEN concat(left({letters}, 1), rpad(left({once}, 3), 3, '0')) END"


def _json_value(v: str) -> str:
    """A variant as text: strings bare, booleans as 1 and 0."""
    kind = f"schema_of_variant({v})"
    return f"CASE {kind} WHEN 'BOOLEAN' THEN CAST(try_variant_get({v}, '$', 'boolean') AS INT) || '' WHEN 'STRING' THEN try_variant_get({v}, '$', 'string') ELSE to_json({v}) END"


@sql_function("json_extract")
def _json_extract(doc: str, *paths: str) -> str:
    values = [_json_value(f"try_variant_get(try_parse_json({text(doc)}), {p}, 'variant')") for p in paths]
    if len(values) == 1:
        return f"({values[0]})"
    return f"CASE WHEN coalesce({', '.join(values)}) IS NOT NULL THEN concat('[', concat_ws(', ', {', '.join(values)}), ']') END"


simple("json_extract1", f"to_json(try_variant_get(try_parse_json({S0}), {{1}}, 'variant'))")
simple("json_valid", f"CASE WHEN {S0} IS NOT NULL THEN try_parse_json({S0}) IS NOT NULL END")


@sql_function("json_type")
def _json_type(v: str) -> str:
    kind = f"upper(schema_of_variant(try_parse_json({text(v)})))"
    return f"CASE WHEN {kind} IN ('BIGINT', 'INT', 'SMALLINT', 'TINYINT') THEN 'INTEGER' WHEN {kind} LIKE 'DECIMAL%' OR {kind} IN ('DOUBLE', 'FLOAT') THEN 'DOUBLE' WHEN {kind} = 'BOOLEAN' THEN 'BOOLEAN' WHEN {kind} = 'VOID' THEN 'NULL' WHEN {kind} LIKE 'OBJECT%' THEN 'OBJECT' WHEN {kind} LIKE 'ARRAY%' THEN 'ARRAY' WHEN {text(v)} IS NOT NULL THEN 'STRING' ELSE 'NULL' END"


@sql_function("json_array")
def _json_array(*args: str) -> str:
    return f"to_json(array({', '.join(map(text, args))}))" if args else "'[]'"


@sql_function("json_object")
def _json_object(*args: str) -> str:
    if len(args) % 2:
        return "CAST(NULL AS STRING)"
    if not args:
        return "'{}'"
    quoted = [f"substring(to_json(array({text(x)})), 2, length(to_json(array({text(x)}))) - 2)" for x in args]
    fields = ", ',', ".join(f"{k}, ':', {v}" for k, v in zip(quoted[::2], quoted[1::2], strict=True))
    return none_null(args[::2], f"concat('{{', {fields}, '}}')")
