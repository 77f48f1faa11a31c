"""Addresses, networks and ports as column expressions.

An address becomes a key: hexadecimal digits of fixed length, 8 for version 4 and 32 for
version 6, so that a network is a range of keys of one length.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
V4 = rf"\A{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}\z"
#: Non-public version 4 ranges: unspecified, private, shared, loopback, link-local, private,
#: private, multicast, broadcast.
PRIVATE_V4 = (
    ("00000000", "00000000"),
    ("0a000000", "0affffff"),
    ("64400000", "647fffff"),
    ("7f000000", "7fffffff"),
    ("a9fe0000", "a9feffff"),
    ("ac100000", "ac1fffff"),
    ("c0a80000", "c0a8ffff"),
    ("e0000000", "efffffff"),
    ("ffffffff", "ffffffff"),
)
#: Non-public version 6 prefixes: unspecified and loopback in full, then unique local,
#: link-local and multicast.
PRIVATE_V6 = r"\A(0{31}[01]|f[cd]|fe[89ab]|ff)"
MAPPED = "0" * 20 + "ffff"


def v4_key(ip: Column) -> Column:
    """Key of a dotted version 4 address, else null."""
    part = F.split(ip, r"\.")
    n = part[0].cast("bigint") * 16777216 + part[1].cast("bigint") * 65536 + part[2].cast("bigint") * 256 + part[3].cast("bigint")
    return F.when(ip.rlike(V4), F.lpad(F.lower(F.hex(n)), 8, "0"))


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated, and written into the plan, once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _groups(side: Column) -> Column:
    """Hexadecimal digits of colon-separated groups."""
    return F.when(side == "", F.lit("")).otherwise(F.array_join(F.transform(F.split(side, ":"), lambda g: F.lpad(g, 4, "0")), ""))


def v6_key(ip: Column) -> Column:
    """Key of a version 6 address, else null."""

    def undotted(low: Column) -> Column:
        """A dotted tail as two groups; one that is no version 4 address spoils the whole."""
        tail = F.regexp_extract(low, r"([0-9.]*\.[0-9.]*)\z", 1)
        return _let(
            tail,
            lambda t: F.when(t == "", low).otherwise(
                _let(v4_key(t), lambda k: F.concat(F.left(low, F.length(low) - F.length(t)), F.left(k, F.lit(4)), F.lit(":"), F.right(k, F.lit(4))))
            ),
        )

    def joined(text: Column) -> Column:
        def whole(x: Column) -> Column:
            digits = F.length(x["a"]) + F.length(x["b"])
            zeros = F.repeat(F.lit("0"), F.greatest(F.lit(0), F.lit(32) - digits).cast("int"))
            return F.when(text.contains("::") & (digits <= 28), F.concat(x["a"], zeros, x["b"])).when(
                ~text.contains("::") & (digits == 32), x["a"]
            )

        halves = F.split(text, "::", -1)
        return _let(
            F.struct(_groups(halves[0]).alias("a"), _groups(F.coalesce(F.get(halves, F.lit(1)), F.lit(""))).alias("b")), whole
        )

    shape = r"\A(([0-9a-f]{1,4}:)*[0-9a-f]{1,4})?(::(([0-9a-f]{1,4}:)*[0-9a-f]{1,4})?)?\z"
    return _let(undotted(F.lower(ip)), lambda t: F.when(t.rlike(shape), joined(t)))


def address_key(ip: Column) -> Column:
    """Key of an address of either version, null if it is none."""
    return F.coalesce(v4_key(ip), v6_key(ip))


def canonical_key(key: Column) -> Column:
    """FN-6: a version 4 address mapped into version 6 is that version 4 address."""
    return F.when((F.length(key) == 32) & key.startswith(MAPPED), F.substring(key, 25, 8)).otherwise(key)


def is_private(key: Column) -> Column:
    """FN-5 on a canonical key: whether the address is not a public one."""
    v4 = F.lit(False)
    for lo, hi in PRIVATE_V4:
        v4 = v4 | key.between(lo, hi)
    return F.when(F.length(key) == 8, v4).otherwise(key.rlike(PRIVATE_V6))


def network_bound(key: Column, prefix: Column, low: bool) -> Column:
    """First or last key of the network of ``prefix`` bits around ``key``."""
    whole = F.floor(prefix / 4).cast("int")
    rest = F.pmod(prefix, F.lit(4)).cast("int")
    nibble = F.conv(F.substring(key, whole + 1, F.lit(1)), 16, 10).cast("int")
    span = F.element_at(F.array(F.lit(16), F.lit(8), F.lit(4), F.lit(2)), rest + 1)
    first = nibble - F.pmod(nibble, span)
    edge = F.when(F.lit(low), first).otherwise(first + span - 1)
    joint = F.when(whole * 4 < F.length(key) * 4, F.lower(F.hex(edge.cast("bigint")))).otherwise("")
    return F.rpad(F.concat(F.substring(key, F.lit(1), whole), joint), F.length(key), F.lit("0" if low else "f"))


def in_network(key: Column, lo: Column, hi: Column) -> Column:
    """FN-7: containment, of one family; a prefix of 0 holds its whole family."""
    return (F.length(key) == F.length(lo)) & key.between(lo, hi)


def in_ports(port: Column, ranges: Column) -> Column:
    """FN-8: whether one of the inclusive (start, end) ranges holds the port; none = any port."""
    return (F.size(ranges) == 0) | F.exists(ranges, lambda r: port.between(r["start"], r["end"]))


def protocol_fits(rule: Column, proto: Column) -> Column:
    """FN-9: any, tcp = 6, udp = 17."""
    return (rule == "any") | ((rule == "tcp") & (proto == 6)) | ((rule == "udp") & (proto == 17))
