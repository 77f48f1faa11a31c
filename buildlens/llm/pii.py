"""Format-preserving pseudonyms for personal data, in DataFrame functions alone.

A keyed Feistel network permutes each validated value within its own format, so equal values
get equal pseudonyms in every document and the pseudonym passes the validation that found it:

* card numbers of 13 to 19 digits, plain or in groups of which the first has at least 3 digits,
  that pass the Luhn test: all digits but the last are permuted, the last is the new check
  digit, and groups stay; up to two groups more after a card are left as they are;
* account numbers (IBAN), plain or in groups of four, that pass the mod 97 test: what follows
  the check digits is permuted, and they are made new;
  numbers that fail the test are no card numbers and stay;
* telephone numbers: the digits after the country code are permuted, and their grouping, which
  does not matter, stays;
* social-security-like numbers without a group of zeros only: permuted among those;
* IPv4 addresses with octets of 0 to 255: permuted as 32-bit numbers;
* calendar dates (year first or last, parted by -, / or .; with the year last the day comes
  first, or the month if that is no date; fields of one digit too): permuted among the days of
  1900 to 2099, in the order they have; zeros before digits as in the date found;
* e-mail addresses: letters and digits of the local part and of the domain before its last
  label are permuted within their class; case does not matter and stays.

The network works on strings: a half is shifted character by character, within its class
(digit, lower-case, upper-case letter), by a stream that SHA-256 makes of the key, the round
and the other half. Other characters stay where they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Domain of the date permutation: the 17 * 4297 days from 1900-01-01 to 2099-12-31.
DAY_A, DAY_B, DAY_ZERO = 17, 4297, "1900-01-01"

#: Java patterns by kind; the first that fits at a place wins.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9./-])(?:(?:19|20)[0-9]{2}(?:-[0-9]{1,2}-|/[0-9]{1,2}/|\.[0-9]{1,2}\.)[0-9]{1,2}|[0-9]{1,2}(?:-[0-9]{1,2}-|/[0-9]{1,2}/|\.[0-9]{1,2}\.)(?:19|20)[0-9]{2})(?![0-9/-]|\.[0-9])",
    "phone": r"(?<![0-9A-Za-z+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){1,4}(?![0-9])|(?<![0-9A-Za-z+(])(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9]|[ -][0-9])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![0-9A-Za-z])",
    "number": r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|(?=[0-9](?:[ -]?[0-9]){12})[0-9]{3,}(?:[ -][0-9]+){1,8})(?![0-9A-Za-z])",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _stream(key: Column, r: Column, other: Column) -> Column:
    return F.sha2(F.concat_ws("|", key, r.cast("string"), other), 256)


def _shift(half: Column, stream: Column) -> Column:
    """Every digit and ASCII letter of ``half`` moved within its class by the stream's bytes."""

    def moved(i: Column) -> Column:
        c = F.ascii(F.substring(half, i, F.lit(1)))
        k = F.conv(F.substring(stream, F.lit(1) + 2 * F.pmod(i - 1, F.lit(32)), F.lit(2)), 16, 10).cast("int")
        put = lambda first, n: F.char((F.lit(first) + F.pmod(c - first + k, F.lit(n))).cast("bigint"))
        return (
            F.when(c.between(48, 57), put(48, 10))
            .when(c.between(97, 122), put(97, 26))
            .when(c.between(65, 90), put(65, 26))
            .otherwise(F.substring(half, i, F.lit(1)))
        )

    return F.when(F.length(half) == 0, F.lit("")).otherwise(
        F.array_join(F.transform(F.sequence(F.lit(1), F.length(half)), moved), "")
    )


def permuted(text: Column, key: Column) -> Column:
    """The string Feistel network: a keyed permutation of the strings of one shape."""
    n = F.length(text)
    start = F.struct(
        F.substring(text, F.lit(1), F.floor(n / 2).cast("int")).alias("a"),
        F.substring(text, F.floor(n / 2).cast("int") + 1, n).alias("b"),
    )
    end = F.aggregate(
        F.array(*[F.lit(r) for r in range(ROUNDS)]),
        start,
        lambda s, r: F.struct(
            s["b"].alias("a"),
            _let(_stream(key, r, s["b"]), lambda h: _shift(s["a"], h)).alias("b"),
        ),
    )
    return _let(end, lambda e: F.concat(e["a"], e["b"]))


def _numeric(left: Column, right: Column, size_l: int, size_r: int, key: Column) -> Column:
    """The pair (left, right) of numbers below the two sizes, permuted: struct(a, b)."""
    sizes = [size_l, size_r] * (ROUNDS // 2)
    return F.aggregate(
        F.array(*[F.struct(F.lit(r).alias("r"), F.lit(m).alias("m")) for r, m in enumerate(sizes)]),
        F.struct(left.cast("bigint").alias("a"), right.cast("bigint").alias("b")),
        lambda s, x: F.struct(
            s["b"].alias("a"),
            F.pmod(
                s["a"] + F.conv(F.substring(_stream(key, x["r"], s["b"].cast("string")), 1, 12), 16, 10).cast("bigint"),
                x["m"],
            ).alias("b"),
        ),
    )


def luhn_sum(digits: Column, odd: int) -> Column:
    """The Luhn sum; ``odd`` = 1 doubles the first digit from the right, 0 the second."""
    n = F.length(digits)
    return F.aggregate(
        F.sequence(F.lit(1), n),
        F.lit(0),
        lambda s, i: s
        + _let(
            F.substring(digits, n - i + 1, F.lit(1)).cast("int"),
            lambda d: F.when(F.pmod(i, F.lit(2)) == odd, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d),
        ),
    )


def luhn_valid(digits: Column) -> Column:
    return F.pmod(luhn_sum(digits, 0), F.lit(10)) == 0


def _refilled(value: Column, marks: Column, what: str) -> Column:
    """``value`` with its characters of the class ``what`` replaced by those of ``marks``, in order."""
    at = lambda i: F.length(F.regexp_replace(F.substring(value, F.lit(1), i), f"[^{what}]", ""))
    put = lambda i: _let(
        F.substring(value, i, F.lit(1)), lambda c: F.when(c.rlike(f"[{what}]"), F.substring(marks, at(i), F.lit(1))).otherwise(c)
    )
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(value)), put), "")


def card_of(value: Column) -> Column:
    """The longest start of a number, at the end of a group, that is a card; null if none is."""
    one = F.regexp_replace(value, r"[ -][0-9]+\z", "")
    starts = F.array(value, one, F.regexp_replace(one, r"[ -][0-9]+\z", ""))
    fits = lambda v: _let(F.regexp_replace(v, "[^0-9]", ""), lambda d: F.length(d).between(13, 19) & luhn_valid(d))
    return F.get(F.filter(starts, fits), F.lit(0))


def _card(value: Column, key: Column) -> Column:
    """A number with a new check digit in its last place; groups stay, and do not matter."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    body = permuted(F.substring(digits, F.lit(1), F.length(digits) - 1), key)
    new = lambda b: F.concat(b, F.pmod(10 - F.pmod(luhn_sum(b, 1), F.lit(10)), F.lit(10)).cast("string"))
    return _let(_let(body, new), lambda d: _refilled(value, d, "0-9"))


def mod97(text: Column) -> Column:
    """The remainder by 97 of digits and letters, where A is 10 and Z is 35."""
    return F.aggregate(
        F.sequence(F.lit(1), F.length(text)),
        F.lit(0),
        lambda r, i: _let(
            F.ascii(F.substring(text, i, F.lit(1))),
            lambda c: F.when(c <= 57, F.pmod(r * 10 + c - 48, F.lit(97))).otherwise(F.pmod(r * 100 + c - 55, F.lit(97))),
        ),
    )


def iban_valid(value: Column) -> Column:
    t = F.replace(value, F.lit(" "), F.lit(""))
    return F.length(t).between(15, 34) & (mod97(F.concat(F.substring(t, F.lit(5), F.length(t)), F.substring(t, 1, 4))) == 1)


def _iban(value: Column, key: Column) -> Column:
    t = F.replace(value, F.lit(" "), F.lit(""))
    land = F.substring(t, 1, 2)
    new = lambda b: F.concat(land, F.lpad((98 - mod97(F.concat(b, land, F.lit("00")))).cast("string"), 2, "0"), b)
    return _let(_let(permuted(F.substring(t, F.lit(5), F.length(t)), key), new), lambda n: _refilled(value, n, "0-9A-Z"))


def _ip(value: Column, key: Column) -> Column:
    part = F.split(value, r"\.")
    octet = lambda i: part[i].cast("int")
    return _let(
        _numeric(octet(0) * 256 + octet(1), octet(2) * 256 + octet(3), 65536, 65536, key),
        lambda p: F.concat_ws(
            ".",
            *[
                F.floor(p[h] / 256).cast("string") if hi else F.pmod(p[h], F.lit(256)).cast("string")
                for h in ("a", "b")
                for hi in (True, False)
            ],
        ),
    )


def _parted(sep: Column, *parts: Column) -> Column:
    return F.concat(parts[0], sep, parts[1], sep, parts[2])


def _date(value: Column, key: Column) -> Column:
    first = value.rlike(r"\A[0-9]{4}")
    part = F.split(value, "[./-]")
    two = lambda i: F.lpad(part[i], 2, "0")
    sep = F.regexp_extract(value, "[./-]", 0)
    dated = lambda y, m, d: F.try_to_date(F.concat_ws("-", y, m, d), "yyyy-MM-dd")
    day_first = dated(part[2], two(1), two(0))
    day = F.when(first, dated(part[0], two(1), two(2))).otherwise(F.coalesce(day_first, dated(part[2], two(0), two(1))))
    bare = value.rlike(r"(?<![0-9])[0-9](?![0-9])")

    def moved(d: Column) -> Column:
        n = F.datediff(d, F.lit(DAY_ZERO).cast("date"))
        to = _let(
            _numeric(F.floor(n / DAY_B), F.pmod(n, F.lit(DAY_B)), DAY_A, DAY_B, key),
            lambda p: F.date_add(F.lit(DAY_ZERO).cast("date"), (p["a"] * DAY_B + p["b"]).cast("int")),
        )
        number = lambda t, f: F.when(bare, F.regexp_replace(F.date_format(t, f), r"\A0", "")).otherwise(F.date_format(t, f))

        def shown(t: Column) -> Column:
            y, m, d = F.date_format(t, "yyyy"), number(t, "MM"), number(t, "dd")
            return F.when(first, _parted(sep, y, m, d)).when(day_first.isNotNull(), _parted(sep, d, m, y)).otherwise(_parted(sep, m, d, y))

        return _let(to, shown)

    return F.coalesce(_let(day, moved), value)


def _cased(text: Column, like: Column) -> Column:
    """``text`` in upper case where ``like``, of the same length, is."""
    at = lambda c, i: F.substring(c, i, F.lit(1))
    put = lambda i: F.when(at(like, i).rlike("[A-Z]"), F.upper(at(text, i))).otherwise(at(text, i))
    return F.when(~like.rlike("[A-Z]"), text).otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.length(like)), put), ""))


def _email(value: Column, key: Column) -> Column:
    local = F.substring_index(value, "@", 1)
    top = F.substring_index(value, ".", -1)
    host = F.substring(
        value, F.length(local) + 2, F.length(value) - F.length(local) - F.length(top) - F.lit(2)
    )
    put = lambda part: _let(permuted(F.lower(part), key), lambda p: _cased(p, part))
    return F.concat(put(local), F.lit("@"), put(host), F.lit("."), top)


def _phone(value: Column, key: Column) -> Column:
    code = F.regexp_extract(value, r"\A(\+[0-9]{1,3}(?=[ .(-])|\+[0-9]|)", 1)
    rest = F.substring(value, F.length(code) + 1, F.length(value))
    return _let(permuted(F.regexp_replace(rest, "[^0-9]", ""), key), lambda d: F.concat(code, _refilled(rest, d, "0-9")))


def _ssn(value: Column, key: Column) -> Column:
    part = F.split(value, "-")
    number = lambda i: part[i].cast("bigint") - 1
    two = lambda n, wide: F.lpad((n + 1).cast("bigint").cast("string"), wide, "0")
    return _let(
        _numeric(number(0), number(1) * 9999 + number(2), 999, 99 * 9999, key),
        lambda p: F.concat_ws("-", two(p["a"], 3), two(F.floor(p["b"] / 9999), 2), two(F.pmod(p["b"], F.lit(9999)), 4)),
    )


def kind_of(value: Column) -> Column:
    """The kind of a match, by the shape that its pattern allows no other kind to have."""
    return (
        F.when(value.contains("@"), "email")
        .when(value.rlike(r"\A[0-9]{1,3}(\.[0-9]{1,3}){3}\z"), "ip")
        .when(value.rlike(r"\A([0-9]{4}[./-][0-9]{1,2}[./-][0-9]{1,2}|[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{4})\z"), "date")
        .when(value.rlike(r"\A[0-9]{3}-[0-9]{2}-[0-9]{4}\z"), F.when(value.rlike(r"\A(000-|[0-9]{3}-00-|[0-9]{3}-[0-9]{2}-0000)"), "plain").otherwise("ssn"))
        .when(value.rlike(r"\A[A-Z]"), F.when(iban_valid(value), "iban").otherwise("plain"))
        .when(value.rlike(r"\A[0-9]([ -]?[0-9]){12,}\z"), F.when(card_of(value).isNotNull(), "card").otherwise("plain"))
        .otherwise("phone")
    )


def pseudonym(value: Column, key: Column) -> Column:
    """The pseudonym of a match. A date that no calendar has and a number that fails its check stay."""

    def of(kind: Column) -> Column:
        named = F.concat_ws("|", key, kind)
        return (
            F.when(kind == "email", _email(value, named))
            .when(kind == "ip", _ip(value, named))
            .when(kind == "date", _date(value, named))
            .when(kind == "card", _let(card_of(value), lambda c: F.concat(_card(c, named), F.substring(value, F.length(c) + 1, F.length(value)))))
            .when(kind == "iban", _iban(value, named))
            .when(kind == "plain", value)
            .when(kind == "phone", _phone(value, named))
            .otherwise(_ssn(value, named))
        )

    return _let(kind_of(value), of)


def pseudonymised(text: Column, key: Column) -> Column:
    """``text`` with every match replaced. Null stays null."""
    found = F.regexp_extract_all(text, F.lit(ANY), F.lit(0))
    put = F.transform(found, lambda v: pseudonym(v, key))
    # split() drops nothing with a limit of -1, so there is one piece more than matches
    joined = F.zip_with(
        F.split(text, ANY, -1), put, lambda piece, p: F.concat(piece, F.coalesce(p, F.lit("")))
    )
    return F.when(text.rlike("[0-9@]"), F.array_join(joined, "")).otherwise(text)


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with personal data in ``text`` replaced; all columns and rows stay.

    A null text stays null and an empty one empty. Repeated rows get equal results. An empty
    table gives an empty result. Other columns pass through, whatever their names.
    """
    return docs.withColumn(text, pseudonymised(F.col(text), F.lit(key)))


def personal_values(text: Column) -> Column:
    """All validated values in a text, in order."""
    return F.filter(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), lambda v: kind_of(v) != "plain")
