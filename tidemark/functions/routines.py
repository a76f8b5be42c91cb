"""The dialect's functions as Spark SQL text, by name; arguments are SQL texts already rewritten."""

from __future__ import annotations

import re
from collections.abc import Callable

from ..errors import SqlError

# Strftime codes and their date_format patterns.
STRFTIME = {
    "Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "y": "yy", "j": "DDD", "B": "MMMM", "b": "MMM", "A": "EEEE", "a": "EEE", "p": "a", "I": "hh", "f": "SSSSSS",
}

_SPACE = r"r'(?U)%s'"
_RANDOM = re.compile(r"\b(?:rand|random|randn|uuid|shuffle|uniform|randstr|monotonically_increasing_id)\s*\(", re.I)
_LONG = 600


def literal(sql: str) -> str | None:
    """The text of a string literal, else None."""
    return sql[1:-1].replace("\\'", "'").replace("\\\\", "\\") if len(sql) > 1 and sql[0] == sql[-1] == "'" else None


def quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def strftime_pattern(code: str) -> str:
    out, plain, i = [], "", 0
    while i < len(code):
        c = code[i]
        if c == "%" and i + 1 < len(code):
            i += 1
            if code[i] in STRFTIME:
                out += [f"'{plain}'" if plain else "", STRFTIME[code[i]]]
                plain = ""
            else:
                plain += code[i]
        else:
            plain += c if c != "'" else "''"
        i += 1
    return "".join([*out, f"'{plain}'" if plain else ""])


_PERCENT = r"'\u0001'"


def _strftime(a: str, b: str) -> str:
    """The format comes first or second, whichever is a literal with a percent sign; else first."""
    fmt, value = (b, a) if literal(b) and "%" in literal(b) and not (literal(a) and "%" in literal(a)) else (a, b)
    text = literal(fmt)
    if text is not None:
        return f"date_format({value}, {quoted(strftime_pattern(text))})"
    made = f"replace({fmt}, '%%', {_PERCENT})"
    for code, pattern in STRFTIME.items():
        made = f"replace({made}, '%{code}', date_format({value}, '{pattern}'))"
    return f"replace({made}, {_PERCENT}, '%')"


def micros(x: str) -> str:
    """Microseconds since 1970-01-01 of a date, timestamp or text as it reads, whatever the session's time zone."""
    t = f"CAST({x} AS TIMESTAMP_NTZ)"
    return f"(datediff(CAST({t} AS DATE), DATE '1970-01-01') * 86400000000L + hour({t}) * 3600000000L + minute({t}) * 60000000L + CAST(extract(SECOND FROM {t}) * 1000000 AS BIGINT))"


def _from_seconds(seconds: str) -> str:
    """The timestamp so many seconds after 1970-01-01, without a zone."""
    return f"(TIMESTAMP_NTZ '1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, {seconds}))"


def once(x: str, body: Callable[[str], str]) -> str:
    """``body`` of a value that is computed once.  Catalyst computes a repeated deterministic text once by itself; one that
    gives another value each time, or that would make the statement too long, is bound to a lambda's variable."""
    if len(x) <= _LONG and not _RANDOM.search(x):
        return body(x)
    return f"element_at(transform(array({x}), __v -> {body('__v')}), 1)"


def makes_date(sql: str) -> bool:
    """Whether an expression's text shows that it is a date."""
    s = sql.upper()
    while s.startswith("(") and s.endswith(")"):
        s = s[1:-1]
    return s.startswith(("DATE '", "TRY_CAST(") + ("MAKE_DATE(", "CURRENT_DATE", "LAST_DAY(", "DATE_ADD(", "ADD_MONTHS(")) and (not s.startswith("TRY_CAST(") or s.endswith("AS DATE)"))


def date_part(field: str, x: str) -> str:
    f = (literal(field) or field).lower()
    made = {
        "dow": f"(dayofweek({x}) - 1)", "dayofweek": f"(dayofweek({x}) - 1)", "isodow": f"(weekday({x}) + 1)", "doy": f"dayofyear({x})", "dayofyear": f"dayofyear({x})",
        "week": f"weekofyear({x})", "epoch": f"floor({micros(x)} / 1000000.0BD)", "quarter": f"quarter({x})", "year": f"year({x})", "month": f"month({x})", "day": f"dayofmonth({x})",
        "hour": f"hour({x})", "minute": f"minute({x})", "second": f"second({x})",
    }
    if f not in made:
        raise SqlError(f"unknown date part {f}")
    return f"CAST({made[f]} AS BIGINT)"


def date_trunc(unit: str, x: str) -> str:
    made = f"CAST(date_trunc({unit}, {x}) AS TIMESTAMP_NTZ)"
    return f"CAST({made} AS DATE)" if makes_date(x) else made


def date_diff(unit: str, a: str, b: str) -> str:
    """Boundaries of the unit between a and b."""
    u = (literal(unit) or unit).lower().rstrip("s")
    months = f"((year({b}) - year({a})) * 12 + month({b}) - month({a}))"
    if u == "year":
        return f"CAST(year({b}) - year({a}) AS BIGINT)"
    if u == "quarter":
        return f"CAST((year({b}) - year({a})) * 4 + quarter({b}) - quarter({a}) AS BIGINT)"
    if u == "month":
        return f"CAST({months} AS BIGINT)"
    if u == "day":
        return f"CAST(datediff(CAST({b} AS DATE), CAST({a} AS DATE)) AS BIGINT)"
    if u == "week":
        return f"CAST(datediff(trunc({b}, 'WEEK'), trunc({a}, 'WEEK')) div 7 AS BIGINT)"
    size = {"hour": 3600, "minute": 60, "second": 1}.get(u)
    if size is None:
        raise SqlError(f"unknown unit {u}")
    floor = lambda x: f"CAST(floor({micros(x)} / {size * 1000000}.0BD) AS BIGINT)"
    return f"({floor(b)} - {floor(a)})"


def date_add(unit: str, n: str, d: str) -> str:
    u = (literal(unit) or unit).lower().rstrip("s")
    day = f"CAST({d} AS DATE)"
    if u in ("year", "quarter", "month"):
        return f"add_months({day}, CAST({n} AS INT) * {dict(year=12, quarter=3, month=1)[u]})"
    if u in ("week", "day"):
        return f"date_add({day}, CAST({n} AS INT) * {dict(week=7, day=1)[u]})"
    if u in ("hour", "minute", "second"):
        return f"CAST(timestampadd({u.upper()}, {n}, CAST({d} AS TIMESTAMP_NTZ)) AS TIMESTAMP_NTZ)"
    raise SqlError(f"unknown unit {u}")


def _added(sign: str) -> Callable[..., str]:
    def made(*a: str) -> str:
        if len(a) == 3:
            return date_add(a[0], a[1] if sign == "+" else f"-({a[1]})", a[2])
        if a[1].upper().startswith(("INTERVAL", "MAKE_INTERVAL")):
            return f"({a[0]} {sign} {a[1]})"
        return f"{'date_add' if sign == '+' else 'date_sub'}({a[0]}, {a[1]})"

    return made


def _text(x: str) -> str:
    return f"CAST({x} AS STRING)"


def _substr(s: str, start: str, size: str | None = None) -> str:
    return f"substring({s}, greatest({start}, 1)" + (f", greatest({size}, 0))" if size else ")")


def _typeof(x: str) -> str:
    return (
        f"(CASE WHEN typeof({x}) IN ('tinyint', 'smallint', 'int', 'bigint') THEN 'INTEGER' WHEN typeof({x}) = 'string' THEN 'VARCHAR' WHEN typeof({x}) IN ('float', 'double') THEN 'DOUBLE' "
        f"WHEN typeof({x}) LIKE 'timestamp%' THEN 'TIMESTAMP' WHEN typeof({x}) LIKE 'interval%' THEN 'INTERVAL' ELSE upper(typeof({x})) END)"
    )


def _whole(up: int, down: int) -> Callable[[str], str]:
    """A whole number of the argument's own type: its integral part, and ``up`` or ``down`` where a positive or negative part is cut off."""

    def body(v: str) -> str:
        rest = f"{v} % 1"  # NaN for infinite values, which stay
        return f"(CASE WHEN {rest} > 0 AND {rest} < 1 THEN {v} - {rest} + {up} WHEN {rest} < 0 THEN {v} - {rest} - {down} ELSE {v} END)"

    return lambda x: once(x, body)


def _integer(x: str) -> str:
    return once(x, lambda v: f"coalesce(try_cast({_text(v)} AS BIGINT), try_cast(try_cast({_text(v)} AS DOUBLE) AS BIGINT))")


def _coalesce(*a: str) -> str:
    return f"coalesce({', '.join(a)})"


def _if(c: str, a: str, b: str) -> str:
    return f"if({c}, {a}, {b})"


def _length(x: str) -> str:
    return f"CAST(char_length({_text(x)}) AS BIGINT)"


def _bytes(x: str) -> str:
    return f"CAST(octet_length({x}) AS BIGINT)"


def _age(*a: str) -> str:
    return f"({a[0]} - {a[1]})" if len(a) > 1 else f"(current_date() - CAST({a[0]} AS DATE))"


def _today(*_: str) -> str:
    return "current_date()"


def _now(*_: str) -> str:
    return "localtimestamp()"


def _chr(n: str) -> str:
    return f"decode(unhex(lpad(hex({n}), 8, '0')), 'UTF-32')"


def _contains_all(name: str) -> Callable[..., str]:
    return lambda *a: f"{name}({', '.join(a)})"


SCALAR: dict[str, Callable[..., str]] = {
    "IFNULL": _coalesce, "NVL": _coalesce, "IIF": _if, "IF": _if, "ISNULL": lambda x: f"isnull({x})", "IS_NULL": lambda x: f"isnull({x})",
    "ISNAN": lambda x: f"coalesce(isnan(try_cast({_text(x)} AS DOUBLE)), false)", "TYPEOF": _typeof,
    "LENGTH": _length, "LEN": _length, "CHAR_LENGTH": _length, "CHARACTER_LENGTH": _length, "OCTET_LENGTH": _bytes, "BYTE_LENGTH": _bytes,
    "TRIM": lambda x: f"regexp_replace({x}, {_SPACE % '^\\s+|\\s+$'}, '')", "LTRIM": lambda x: f"regexp_replace({x}, {_SPACE % '^\\s+'}, '')", "RTRIM": lambda x: f"regexp_replace({x}, {_SPACE % '\\s+$'}, '')",
    "SUBSTR": _substr, "SUBSTRING": _substr, "CONCAT": lambda *a: f"concat_ws('', {', '.join(map(_text, a))})", "CONCAT_WS": lambda sep, *a: f"concat_ws({', '.join([sep, *map(_text, a)])})",
    "SPLIT_PART": lambda s, d, n: f"split_part({s}, {d}, greatest({n}, 1))", "STARTS_WITH": _contains_all("startswith"), "ENDS_WITH": _contains_all("endswith"),
    "POSITION": lambda needle, text: f"CAST(locate({needle}, {text}) AS BIGINT)", "CHR": _chr, "CHAR": _chr,
    "TO_VARCHAR": _text, "TO_STRING": _text, "TO_NUMBER": lambda x: f"try_cast({_text(x)} AS DOUBLE)", "TO_NUMERIC": lambda x: f"try_cast({_text(x)} AS DOUBLE)", "TO_DOUBLE": lambda x: f"try_cast({_text(x)} AS DOUBLE)",
    "TO_INTEGER": _integer, "TO_INT": _integer,
    "CEIL": _whole(1, 0), "CEILING": _whole(1, 0), "FLOOR": _whole(0, 1), "TRUNC": _whole(0, 0), "TRUNCATE": _whole(0, 0), "POW": _contains_all("power"),
    "LOG": lambda *a: f"log10({a[0]})" if len(a) == 1 else f"log({a[0]}, {a[1]})", "MOD": _contains_all("try_mod"), "ARRAY_LENGTH": _contains_all("size"), "ARRAY_SIZE": _contains_all("size"),
    "CURRENT_DATE": _today, "TODAY": _today, "GETDATE": _today, "NOW": _now, "CURRENT_TIMESTAMP": _now,
    "DATE": lambda x: f"try_cast({x} AS DATE)", "TIMESTAMP": lambda x: f"try_cast({x} AS TIMESTAMP_NTZ)", "TO_DATE": lambda x: f"try_cast({x} AS DATE)",
    "YEAR": lambda x: f"year(try_cast({x} AS DATE))", "MONTH": lambda x: f"month(try_cast({x} AS DATE))", "DAY": lambda x: f"dayofmonth(try_cast({x} AS DATE))", "DAYOFMONTH": lambda x: f"dayofmonth(try_cast({x} AS DATE))",
    "DATE_TRUNC": date_trunc, "DATE_PART": date_part, "DATEPART": date_part, "EXTRACT": date_part,
    "DATEDIFF": lambda *a: date_diff(*a) if len(a) == 3 else f"datediff(CAST({a[0]} AS DATE), CAST({a[1]} AS DATE))", "DATE_DIFF": lambda *a: date_diff(*a) if len(a) == 3 else f"datediff(CAST({a[0]} AS DATE), CAST({a[1]} AS DATE))",
    "DATE_ADD": _added("+"), "DATEADD": _added("+"), "DATE_SUB": _added("-"), "STRFTIME": _strftime, "FORMAT_DATE": _strftime,
    "EPOCH": lambda x: f"CAST(floor({micros(x)} / 1000000.0BD) AS BIGINT)", "EPOCH_MS": lambda x: f"CAST(floor({micros(x)} / 1000.0BD) AS BIGINT)", "AGE": _age,
    "TO_TIMESTAMP": lambda x: _from_seconds(x) if literal(x) is None else f"try_cast({x} AS TIMESTAMP_NTZ)",
    "DAYNAME": lambda d: f"date_format({d}, 'EEEE')", "MONTHNAME": lambda d: f"date_format({d}, 'MMMM')",
}

AGGREGATE_NAMES = {"STDEV": "stddev_samp", "STDDEV": "stddev_samp", "VARIANCE": "var_samp", "ARG_MIN": "min_by", "ARG_MAX": "max_by"}


def cast(x: str, kind: str, generic: bool = False) -> str:
    """CAST that gives null where the value does not convert.  ``generic`` also takes dates and
    timestamps to numbers and back, by way of the value's own type."""
    return once(x, lambda v: _cast(v, kind, generic))


def _cast(x: str, kind: str, generic: bool) -> str:
    if kind == "STRING":
        return _text(x)
    if kind.startswith("INTERVAL"):
        return f"CAST(NULL AS {kind})"  # no value converts to an interval
    if kind == "BOOLEAN":
        return f"(CASE lower({_text(x)}) WHEN 'on' THEN true WHEN 'off' THEN false ELSE try_cast({_text(x) if generic else x} AS BOOLEAN) END)"
    if kind == "BIGINT" and not generic:
        return f"coalesce(try_cast({x} AS BIGINT), try_cast(try_cast({x} AS DOUBLE) AS BIGINT))"
    if kind == "BIGINT":
        return (
            f"(CASE WHEN typeof({x}) = 'date' THEN CAST(datediff(try_cast({_text(x)} AS DATE), DATE '1970-01-01') AS BIGINT) WHEN typeof({x}) LIKE 'timestamp%' THEN {micros(f'try_cast({_text(x)} AS TIMESTAMP_NTZ)')} "
            f"WHEN typeof({x}) = 'boolean' THEN if({_text(x)} = 'true', 1L, 0L) ELSE {_integer(x)} END)"
        )
    if kind == "DATE" and generic:
        return f"(CASE WHEN typeof({x}) IN ('int', 'bigint') THEN date_add(DATE '1970-01-01', try_cast({_text(x)} AS INT)) ELSE try_cast({_text(x)} AS DATE) END)"
    if kind == "TIMESTAMP_NTZ" and generic:
        return f"(CASE WHEN typeof({x}) IN ('int', 'bigint') THEN {_from_seconds(f'try_cast({_text(x)} AS DECIMAL(20, 0)) / 1000000')} ELSE try_cast({_text(x)} AS TIMESTAMP_NTZ) END)"
    return f"try_cast({x} AS {kind})"
