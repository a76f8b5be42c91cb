"""Format-preserving Feistel pseudonyms for personal data (operator 5), DataFrame functions only.

Values are found by regular expressions, validated (Luhn, mod 97, calendar,
octets, number plan) and replaced by a keyed permutation of their own format, so
an equal value gets an equal pseudonym in every document and two values never
share one.  Three Feistel networks do it, all with SHA-256 of key, round and the
other half as round function:

* letters and digits in place (phone, card and account numbers, mail addresses,
  keys, hexadecimal secrets, IPv6 addresses written out): each symbol of one half is shifted within its own alphabet by the
  other half; separators, country codes and top-level domains stay; check digits
  are computed anew;
* IPv4 addresses: two 16-bit halves;
* dates from 1900-01-01 on: the day number in 270 x 271 days, both halves mod
  their own radix, so no cycle walking is needed;
* US social security numbers: 898 x 99 areas and groups x 9999 serials.

A text is searched for mail addresses, secrets, account numbers, addresses, dates and
social security numbers, what is left of it for card numbers, and what is left then
for phone numbers.  An account or card number that fails its check as it was matched is
searched for valid runs of its groups, those that cut no hyphenated number, standard card
layouts and longer runs first: of a
run of digits with single blanks or hyphens, card numbers are the whole run or its first
13 to 19 digits in any layout, and any other 13 to 19 digits in groups of three or more
that begin as the number plan of cards says (2221 to 2720, 3 to 6).

One narrow stage, no shuffle, no Python.  Defined results: a null text stays null
with 0 values; a number that fails its check, or a date that is not in the
calendar, stays as it is; every other column is carried as it was, and ``kinds`` must name none of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrowmap import free_name

KEY = "change-me"
ROUNDS = 8

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_GROUP = "[0-9A-Fa-f]{1,4}"
# Every repeated group is bounded, so that no text is too long for the regular expressions' stack.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]{1,63}+(?:\.[A-Za-z0-9-]{1,63}+){0,125}\.[A-Za-z]{2,63}+",
    "key": r"(?<![0-9A-Za-z_-])(?:A[KS]IA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36,255}+|sk-[0-9A-Za-z_-]{20,255}+|xox[abprs]-[0-9A-Za-z-]{10,255}+|AIza[0-9A-Za-z_-]{35})(?![0-9A-Za-z_-])",
    "secret": r"(?<![0-9A-Fa-f])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![0-9A-Za-z])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "ipv6": rf"(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f:]{{0,39}}[0-9])(?:(?:{_GROUP}:){{7}}{_GROUP}|(?:{_GROUP}(?::{_GROUP}){{0,6}})?::(?:{_GROUP}(?::{_GROUP}){{0,6}})?)(?![0-9A-Za-z:])",
    "ip": rf"(?<![0-9.]){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9])(?!\.[0-9])",
    "date": r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9])(?![./-][0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9])(?!-[0-9])",
    "card": r"(?<![0-9+])[0-9][0-9 -]{12,}+",
    "phone": r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}(?![0-9])|(?<![0-9])(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9])",
}
for _kind in ("ip", "date", "ssn"):  # not inside a phone number
    PATTERNS[_kind] = r"(?<!\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?)" + PATTERNS[_kind]
ALONE = ("email", "key", "secret", "iban", "ipv6", "ip", "date", "ssn")  # then parts of account numbers, cards, phone numbers
_CARD_START, _CARD_LAYOUT = "^(?:[3-6]|222[1-9]|22[3-9]|2[3-6]|27[01]|2720)", "^(?:[0-9]{13,19}|[0-9]{4}(?:-[0-9]{4}){3}|[0-9]{4}(?: [0-9]{4}){3}(?: [0-9]{3})?|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5})$"
_PIECES = "array<struct<kind: string, value: string>>"
FIRST_DAY, DAYS_A, DAYS_B = "1900-01-01", 270, 271


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _hex(value: Column) -> Column:
    """The number of up to 15 hexadecimal digits."""
    return F.conv(value, 16, 10).cast("long")


def _digest(key: str, kind: str, turn: Column, half: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), turn.cast("string"), half), 256)


def _network(pair: Column, change, rounds: int, inverse: bool) -> Column:
    """Feistel rounds on struct(l, r): (l, r) becomes (r, l changed by r and the round); an even number of rounds."""
    if rounds % 2:
        raise ValueError("rounds must be even")
    if inverse:
        return F.aggregate(F.sequence(F.lit(rounds - 1), F.lit(0)), pair, lambda p, turn: F.struct(change(p["r"], p["l"], turn).alias("l"), p["l"].alias("r")))
    return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), pair, lambda p, turn: F.struct(p["r"].alias("l"), change(p["l"], p["r"], turn).alias("r")))


def two_halves(key: str, kind: str, left: Column, right: Column, a: int, b: int, rounds: int = ROUNDS, inverse: bool = False) -> Column:
    """Feistel permutation of (left in 0..a-1, right in 0..b-1) as a struct (l, r)."""
    sign = -1 if inverse else 1

    def change(half: Column, other: Column, turn: Column) -> Column:
        radix = F.when(turn % 2 == 0, F.lit(a)).otherwise(F.lit(b))
        return F.pmod(half + sign * (_hex(F.substring(_digest(key, kind, turn, other.cast("string")), 1, 12)) % radix), radix)

    return _network(F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), change, rounds, inverse)


def _moved(c: Column, by: Column, alphabet: str) -> Column:
    """The symbol moved in its alphabet: hexadecimal digits, or digits and letters each in their own."""
    code = F.ascii(c)
    if alphabet == "hex":
        value = F.when(code < 58, code - 48).otherwise(code - 87)
        return let(F.pmod(value + by, F.lit(16)), lambda v: F.when(v < 10, F.chr(v + 48)).otherwise(F.chr(v + 87)))
    low = F.when(code < 58, 48).when(code < 91, 65).otherwise(97)
    size = F.when(code < 58, 10).otherwise(26)
    return F.chr(F.pmod(code - low + by, size) + low)


def symbols_in_place(key: str, kind: str, value: Column, alphabet: str = "alnum", rounds: int = ROUNDS, inverse: bool = False) -> Column:
    """Feistel permutation of a string's ASCII letters and digits, each within its alphabet; others stay."""
    sign = -1 if inverse else 1

    def change(half: Column, other: Column, turn: Column) -> Column:
        def moved(h: Column) -> Column:
            def one(c: Column, i: Column) -> Column:
                stream = F.when(i < 16, h).otherwise(F.sha2(F.concat_ws("|", h, F.floor(i / 16).cast("string")), 256))
                return _moved(c, sign * _hex(F.substr(stream, (i % 16) * 4 + 1, F.lit(4))), alphabet)

            return F.transform(half, one)

        return let(_digest(key, kind, turn, F.array_join(other, "")), moved)

    def permuted(s: Column) -> Column:
        cut = F.floor(F.size(s) / 2).cast("int")
        pair = F.struct(F.slice(s, F.lit(1), cut).alias("l"), F.slice(s, cut + 1, F.size(s) - cut).alias("r"))
        return let(_network(pair, change, rounds, inverse), lambda p: F.concat(p["l"], p["r"], F.array(F.lit(""))))

    symbols = F.regexp_extract_all(value, F.lit("[0-9A-Za-z]"), F.lit(0))
    return F.array_join(F.zip_with(F.split(value, "[0-9A-Za-z]", -1), let(symbols, permuted), lambda a, b: F.concat(a, b)), "")


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn_digit(payload: Column) -> Column:
    """Check digit of a string of digits."""
    reversed_digits = F.regexp_extract_all(F.reverse(payload), F.lit("[0-9]"), F.lit(0))
    terms = F.transform(reversed_digits, lambda d, i: let(d.cast("int") * F.when(i % 2 == 0, 2).otherwise(1), lambda x: F.when(x > 9, x - 9).otherwise(x)))
    return F.pmod(-F.aggregate(terms, F.lit(0), lambda acc, x: acc + x), F.lit(10)).cast("string")


def _with_last_digit(value: Column, digit: Column) -> Column:
    return F.concat(F.substr(value, F.lit(1), F.length(value) - 1), digit)


def card(key: str, value: Column) -> Column:
    """Pseudonym of a card number with a right Luhn digit, else null."""
    head = lambda v: F.substr(v, F.lit(1), F.length(v) - 1)
    valid = luhn_digit(head(digits(value))) == F.substr(value, F.length(value), F.lit(1))
    return F.when(valid, let(symbols_in_place(key, "card", head(value)), lambda h: F.concat(h, luhn_digit(digits(h)))))


def _mod97(value: Column) -> Column:
    symbols = F.regexp_extract_all(value, F.lit("[0-9A-Z]"), F.lit(0))
    return F.aggregate(symbols, F.lit(0), lambda acc, c: F.when(F.ascii(c) < 58, acc * 10 + F.ascii(c) - 48).otherwise(acc * 100 + F.ascii(c) - 55) % 97)


def iban(key: str, value: Column) -> Column:
    """Pseudonym of an account number with right check digits, else null."""
    country, body = F.substr(value, F.lit(1), F.lit(2)), F.substr(value, F.lit(5))
    valid = _mod97(F.concat(body, F.substr(value, F.lit(1), F.lit(4)))) == 1
    new = let(symbols_in_place(key, "iban", body), lambda b: F.concat(country, F.lpad((98 - _mod97(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0"), b))
    return F.when(valid, new)


def ip(key: str, value: Column) -> Column:
    def body(o: Column) -> Column:
        pair = two_halves(key, "ip", o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536)
        return let(pair, lambda p: F.concat_ws(".", *(x.cast("string") for x in (F.floor(p["l"] / 256), p["l"] % 256, F.floor(p["r"] / 256), p["r"] % 256))))

    return let(F.transform(F.split(value, r"\."), lambda x: x.cast("int")), body)


def ipv6(key: str, value: Column) -> Column:
    """Pseudonym, all eight groups written out, of an address with eight groups or fewer around ``::``, else null."""

    def body(halves: Column) -> Column:
        groups = lambda h: F.filter(F.split(F.lower(h), ":"), lambda g: g != "")
        left, right = groups(halves[0]), F.when(F.size(halves) > 1, groups(halves[1])).otherwise(F.expr("cast(array() as array<string>)"))
        full = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(8 - F.size(left) - F.size(right), F.lit(0))), right)
        digits_ = F.array_join(F.transform(full, lambda g: F.lpad(g, 4, "0")), "")
        valid = (F.size(full) == 8) & ((F.size(halves) == 1) | (F.size(left) + F.size(right) < 8))
        return F.when(valid, F.array_join(F.regexp_extract_all(symbols_in_place(key, "ipv6", digits_, "hex"), F.lit("[0-9a-f]{4}"), F.lit(0)), ":"))

    return let(F.split(value, "::"), body)


def secret(key: str, value: Column) -> Column:
    """Hexadecimal digits, all in lower or all in upper case."""
    new = symbols_in_place(key, "secret", F.lower(value), "hex")
    return let(new, lambda x: F.when(value.rlike("[A-F]"), F.upper(x)).otherwise(x))


def access_key(key: str, value: Column) -> Column:
    """The prefix that names the kind of key stays."""
    prefix = F.regexp_extract(value, "^(A[KS]IA|gh[pousr]_|sk-|xox[abprs]-|AIza)", 1)
    return let(prefix, lambda p: F.concat(p, symbols_in_place(key, "key", F.substr(value, F.length(p) + 1))))


def date(key: str, value: Column) -> Column:
    """Pseudonym, in the same format, of a day of the calendar from 1900-01-01 on, else null.  dd/mm/yyyy where the
    first number is over 12, else mm/dd/yyyy."""
    n = lambda a, b: F.substr(value, F.lit(a), F.lit(b))
    day_first = n(1, 2) > "12"
    iso = F.when(value.rlike("^[0-9]{4}"), F.concat_ws("-", n(1, 4), n(6, 2), n(9, 2))).when(value.contains(".") | day_first, F.concat_ws("-", n(7, 4), n(4, 2), n(1, 2))).otherwise(F.concat_ws("-", n(7, 4), n(1, 2), n(4, 2)))
    pattern = F.when(value.rlike("^[0-9]{4}-"), "yyyy-MM-dd").when(value.rlike("^[0-9]{4}/"), "yyyy/MM/dd").when(value.contains("."), "dd.MM.yyyy").otherwise("MM/dd/yyyy")
    first = F.lit(FIRST_DAY).cast("date")

    def body(d: Column) -> Column:
        def formatted(p: Column) -> Column:
            day = F.date_add(first, (p["l"] * DAYS_B + p["r"]).cast("int"))
            y, m, x = F.date_format(day, "yyyy"), F.date_format(day, "MM"), F.date_format(day, "dd")
            shaped = F.when(pattern == "yyyy-MM-dd", F.concat_ws("-", y, m, x)).when(pattern == "yyyy/MM/dd", F.concat_ws("/", y, m, x)).when(pattern == "dd.MM.yyyy", F.concat_ws(".", x, m, y))
            return shaped.otherwise(F.concat_ws("/", m, x, y))

        return F.when(d.between(0, DAYS_A * DAYS_B - 1), let(two_halves(key, "date", F.floor(d / DAYS_B), d % DAYS_B, DAYS_A, DAYS_B), formatted))

    return let(F.datediff(iso.try_cast("date"), first), body)


def ssn(key: str, value: Column) -> Column:
    def body(p: Column) -> Column:
        area, group, serial = p[0], p[1], p[2]
        valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
        place = F.when(area > 666, area - 2).otherwise(area - 1)
        pair = two_halves(key, "ssn", place * 99 + group - 1, serial - 1, 898 * 99, 9999)

        def formatted(q: Column) -> Column:
            a = F.floor(q["l"] / 99)
            return F.concat_ws("-", F.lpad(F.when(a > 664, a + 2).otherwise(a + 1).cast("string"), 3, "0"), F.lpad((q["l"] % 99 + 1).cast("string"), 2, "0"), F.lpad((q["r"] + 1).cast("string"), 4, "0"))

        return F.when(valid, let(pair, formatted))

    return let(F.transform(F.split(value, "-"), lambda x: x.cast("int")), body)


def phone(key: str, value: Column) -> Column:
    """The country code (or the + and a digit) stays; 7 to 15 digits in all, else null."""
    code = F.coalesce(F.regexp_extract(value, r"^(\+[0-9]{1,3}(?=[ .(-])|\+[0-9]|)", 1), F.lit(""))
    new = let(code, lambda c: F.concat(c, symbols_in_place(key, "phone", F.substr(value, F.length(c) + 1))))
    return F.when(F.length(digits(value)).between(7, 15), new)


def email(key: str, value: Column) -> Column:
    """The top-level domain stays."""
    return let(F.regexp_extract(value, r"\.[A-Za-z]+$", 0), lambda tld: F.concat(symbols_in_place(key, "email", F.substr(value, F.lit(1), F.length(value) - F.length(tld))), tld))


def _piece(kind: str | None, value: Column) -> Column:
    return F.struct(F.lit(kind).cast("string").alias("kind"), value.alias("value"))


_WINDOWS = "array<struct<rank: int, less: int, a: int, b: int, text: string>>"


def _runs_searched(docs: DataFrame, found: str, kind: str, symbol: str, most: int, valid, rank, make) -> DataFrame:
    """``found`` with the pieces without a kind searched for valid runs inside the matches of the kind's pattern; of those
    that overlap, the runs of the least rank and then the longest are taken first.

    Groups are runs of ``symbol``; ``valid(w)`` and ``rank(w)`` see a run of at most ``most`` groups, all separated by one
    character, as struct(a, b, n, last, cuts, text): its first and last group, its number of symbols, whether more groups would
    be over 19 symbols, whether a hyphen ties it to the group before or after, and its text.  Runs are chosen apart in each
    stretch of groups that overlapping valid runs connect, so the work is in proportion to the text's length unless valid runs
    overlap all along it.  Each step is a projection of its own: the analyzer takes only so many nested lambdas at once.
    """
    pattern = PATTERNS[kind]
    names = {}
    for wanted in ("tokens", "windows", "starts", "kept"):
        names[wanted] = free_name(docs, wanted)
        docs = docs.withColumn(names[wanted], F.lit(None))
    tokens, windows, starts, kept = (names[n] for n in ("tokens", "windows", "starts", "kept"))

    def token(of_kind: Column, value: Column, run: bool) -> Column:
        none = F.expr("cast(array() as array<string>)")
        parts = (F.regexp_extract_all(value, F.lit(f"{symbol}+"), F.lit(0)), F.split(value, f"{symbol}+", -1)) if run else (none, none)
        return F.struct(of_kind.cast("string").alias("kind"), value.alias("value"), parts[0].alias("g"), parts[1].alias("gaps"))

    def split(x: Column) -> Column:
        none = F.lit(None)
        matches = F.concat(F.transform(F.regexp_extract_all(x["value"], F.lit(pattern), F.lit(0)), lambda m: F.array(token(none, m, True))), F.array(F.slice(F.array(token(none, F.lit(""), False)), 1, 0)))
        cut = F.zip_with(F.split(x["value"], pattern, -1), matches, lambda plain, m: F.concat(F.array(token(none, plain, False)), m))
        return F.when(x["kind"].isNull() & x["value"].rlike(pattern), F.flatten(cut)).otherwise(F.array(token(x["kind"], x["value"], False)))

    def text(x: Column, a: Column, b: Column) -> Column:
        """Groups a to b - 1, each with the separator after it (that of group i is gaps[i + 1])."""
        return F.array_join(F.zip_with(F.slice(x["g"], a + 1, b - a), F.slice(x["gaps"], a + 2, b - a), lambda group, gap: F.concat(group, gap)), "")

    def indices(x: Column) -> Column:
        return F.when(F.size(x["g"]) > 0, F.sequence(F.lit(0), F.size(x["g"]) - 1)).otherwise(F.expr("cast(array() as array<int>)"))

    def of_start(x: Column, a: Column) -> Column:
        def row(sizes: Column, k: Column, n: Column) -> Column:
            tied = F.endswith(F.get(x["gaps"], a), F.lit("-")) | F.startswith(F.get(x["gaps"], a + k + 1), F.lit("-"))
            return F.struct(a.alias("a"), (a + k).alias("b"), n.alias("n"), (n + F.coalesce(F.get(sizes, k + 1), F.lit(99)) > 19).alias("last"), tied.alias("cuts"), F.concat(text(x, a, a + k), F.get(x["g"], a + k)).alias("text"))

        def of_sizes(sizes: Column) -> Column:
            count = lambda k: F.aggregate(F.slice(sizes, F.lit(1), k + 1), F.lit(0), lambda acc, y: acc + y)
            apart = lambda k: F.forall(F.slice(x["gaps"], a + 2, k), lambda gap: F.length(gap) == 1)
            rows = F.transform(sizes, lambda _, k: let(count(k), lambda n: F.when((k < most) & n.between(13, 34) & apart(k), row(sizes, k, n))))
            return F.filter(rows, lambda w: w.isNotNull() & valid(w))

        found_here = let(F.transform(F.slice(x["g"], a + 1, F.lit(most + 1)), lambda y: F.length(y)), of_sizes)
        return F.transform(found_here, lambda w: F.struct(rank(w).alias("rank"), (-w["n"]).alias("less"), w["a"].alias("a"), w["b"].alias("b"), w["text"].alias("text")))

    def free(ends: Column, i: Column) -> Column:
        """Whether no valid run goes over from group i - 1 to group i."""
        first = F.greatest(i - most + 1, F.lit(0))
        return (i == 0) | ~F.exists(F.slice(ends, first + 1, i - first), lambda e: e >= i)

    def starts_of(x: Column, by_start: Column) -> Column:
        ends = F.transform(by_start, lambda ws: F.coalesce(F.array_max(F.transform(ws, lambda w: w["b"])), F.lit(-1)))
        return let(ends, lambda e: F.filter(indices(x), lambda i: free(e, i)))

    def chosen(stretch: Column) -> Column:
        none = F.expr("cast(array() as array<struct<a: int, b: int, text: string>>)")
        row = lambda w: F.struct(w["a"].alias("a"), w["b"].alias("b"), w["text"].alias("text"))
        return F.sort_array(F.aggregate(F.sort_array(stretch), none, lambda acc, w: F.when(F.exists(acc, lambda k: (k["a"] <= w["b"]) & (w["a"] <= k["b"])), acc).otherwise(F.concat(acc, F.array(row(w))))))

    def kept_of(at: Column, by_start: Column) -> Column:
        stretches = F.transform(at, lambda i, k: F.flatten(F.slice(by_start, i + 1, F.coalesce(F.get(at, k + 1), F.size(by_start)) - i)))
        return F.flatten(F.transform(F.filter(stretches, lambda y: F.size(y) > 0), chosen))

    def pieces_of(x: Column, k: Column) -> Column:
        def one(w: Column, i: Column) -> Column:
            after = F.coalesce(F.get(k, i - 1)["b"] + 1, F.lit(0))
            return F.array(_piece(None, F.concat(F.get(x["gaps"], after), text(x, after, w["a"]))), _piece(kind, make(w["text"])))

        end = F.try_element_at(k, F.lit(-1))["b"] + 1
        tail = F.array(_piece(None, F.concat(F.get(x["gaps"], end), text(x, end, F.size(x["g"])))))
        return F.when(F.size(k) > 0, F.concat(F.flatten(F.transform(k, one)), tail)).otherwise(F.array(F.struct(x["kind"].alias("kind"), x["value"].alias("value"))))

    docs = docs.withColumn(tokens, F.flatten(F.transform(F.col(found), split)))
    docs = docs.withColumn(windows, F.transform(F.col(tokens), lambda x: F.transform(indices(x), lambda a: of_start(x, a)).cast(f"array<{_WINDOWS}>")))
    docs = docs.withColumn(starts, F.zip_with(tokens, windows, starts_of))
    docs = docs.withColumn(kept, F.zip_with(starts, windows, kept_of))
    return docs.withColumn(found, _joined(F.flatten(F.zip_with(tokens, kept, pieces_of)))).drop(*names.values())


def _card_runs(docs: DataFrame, found: str, key: str) -> DataFrame:
    def valid(w: Column) -> Column:
        planned = w["text"].rlike(_CARD_START) & ~w["text"].rlike("(?<![0-9])[0-9]{1,2}(?![0-9])")
        return (w["n"] <= 19) & (planned | ((w["a"] == 0) & w["last"])) & let(digits(w["text"]), lambda d: luhn_digit(F.substr(d, F.lit(1), F.length(d) - 1)) == F.substr(d, F.length(d), F.lit(1)))

    return _runs_searched(docs, found, "card", "[0-9]", 19, valid, lambda w: F.when(w["cuts"], 2).otherwise(0) + F.when(w["text"].rlike(_CARD_LAYOUT), 0).otherwise(1), lambda v: card(key, v))


def _iban_runs(docs: DataFrame, found: str, key: str) -> DataFrame:
    """Of matches that aren't valid as a whole."""
    valid = lambda w: w["text"].rlike(f"^(?:{PATTERNS['iban']})$") & iban(key, w["text"]).isNotNull()
    return _runs_searched(docs, found, "iban", "[0-9A-Z]", 10, valid, lambda w: F.lit(0), lambda v: iban(key, v))


def pieces(key: str, value: Column, kinds: tuple[str, ...]) -> Column:
    """Array of struct(kind, value) of a match of one of the kinds' patterns; null kind, and the text itself, where it isn't valid."""
    made = {
        "email": lambda: email(key, value), "key": lambda: access_key(key, value), "secret": lambda: secret(key, value), "iban": lambda: iban(key, value), "ipv6": lambda: ipv6(key, value), "ip": lambda: ip(key, value),
        "date": lambda: date(key, value), "ssn": lambda: ssn(key, value), "phone": lambda: phone(key, value),
    }
    row = F.when(F.lit(False), _piece("", F.lit("")))
    for kind in kinds:
        row = row.when(value.rlike(f"^(?:{PATTERNS[kind]})$"), _piece(kind, made[kind]()))
    return let(row, lambda x: F.array(F.when(x["value"].isNotNull(), x).otherwise(_piece(None, value))))


def _joined(parts: Column) -> Column:
    """The pieces, those without a kind that follow each other made one."""

    def of(p: Column) -> Column:
        begins = lambda i: (i == 0) | F.get(p, i)["kind"].isNotNull() | F.get(p, i - 1)["kind"].isNotNull()
        starts = F.filter(F.sequence(F.lit(0), F.size(p) - 1), begins)
        whole = lambda at: F.transform(at, lambda i, k: F.struct(F.get(p, i)["kind"].alias("kind"), F.array_join(F.slice(p, i + 1, F.coalesce(F.get(at, k + 1), F.size(p)) - i)["value"], "").alias("value")))
        return F.when(F.size(p) > 0, let(starts, whole)).otherwise(p)

    return let(parts, of)


def searched(key: str, parts: Column, kinds: tuple[str, ...]) -> Column:
    """The pieces, those without a kind searched for the kinds' patterns."""
    pattern = "|".join(f"(?:{PATTERNS[k]})" for k in kinds)

    def one(x: Column) -> Column:
        found = F.concat(F.transform(F.regexp_extract_all(x["value"], F.lit(pattern), F.lit(0)), lambda m: pieces(key, m, kinds)), F.array(F.expr(f"cast(array() as {_PIECES})")))
        new = F.zip_with(F.split(x["value"], pattern, -1), found, lambda plain, m: F.concat(F.array(_piece(None, plain)), m))
        return F.when(x["kind"].isNull() & x["value"].rlike(pattern), F.flatten(new)).otherwise(F.array(x))

    return _joined(F.flatten(F.transform(parts, one)))


def pseudonymise(docs: DataFrame, *, key: str = KEY, text: str = "text", kinds: str | None = None) -> DataFrame:
    """The documents with their texts' personal data replaced; ``kinds`` names a column for the kinds found, in order."""
    if kinds and kinds.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"there is a column {kinds} already")
    found, t = free_name(docs, "found"), F.col(f"`{text}`")
    out = docs.withColumn(found, F.when(t.rlike("[0-9@]"), F.array(_piece(None, t))))
    out = out.withColumn(found, searched(key, F.col(found), ALONE))
    out = _card_runs(_iban_runs(out, found, key), found, key)
    out = out.withColumn(found, searched(key, F.col(found), ("phone",)))
    out = out.withColumn(text, F.when(F.size(found) > 0, F.array_join(F.col(found)["value"], "")).otherwise(t))
    if kinds:
        out = out.withColumn(kinds, F.coalesce(F.filter(F.transform(found, lambda f: f["kind"]), lambda k: k.isNotNull()), F.expr("cast(array() as array<string>)")))
    return out.drop(found)
