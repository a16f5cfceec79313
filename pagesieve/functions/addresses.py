"""Address literals of URL hosts as numbers, and the special ranges they may fall into.

An IPv4 literal becomes one number, an IPv6 literal two 64-bit halves.  Ranges
are prefixes: an address lies in one if the bits under its mask agree, which
holds for signed halves as well.  All steps are column expressions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Special-purpose IPv4 ranges, by what a crawler calls them.
IPV4_METADATA = ("169.254.169.254/32", "100.100.100.200/32", "192.0.0.192/32")
IPV4_LOOPBACK = ("127.0.0.0/8",)
IPV4_LINK_LOCAL = ("169.254.0.0/16",)
IPV4_MULTICAST = ("224.0.0.0/4",)
IPV4_PRIVATE = (
    "0.0.0.0/8", "10.0.0.0/8", "172.16.0.0/12", "192.0.0.0/24", "192.0.0.170/31", "192.0.2.0/24",
    "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4",
)
IPV4_PUBLIC = ("192.0.0.9/32", "192.0.0.10/32")

# Special-purpose IPv6 ranges.
IPV6_MAPPED = ("::ffff:0:0/96",)
IPV6_LOOPBACK = ("::1/128",)
IPV6_LINK_LOCAL = ("fe80::/10",)
IPV6_MULTICAST = ("ff00::/8",)
IPV6_PRIVATE = ("::/128", "64:ff9b:1::/48", "100::/64", "2001::/23", "2001:db8::/32", "2002::/16", "3fff::/20", "fc00::/7")
IPV6_PUBLIC = ("2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28")
IPV6_RESERVED = (
    "::/8", "100::/8", "200::/7", "400::/6", "800::/5", "1000::/4", "4000::/3", "6000::/3", "8000::/3",
    "a000::/3", "c000::/3", "e000::/4", "f000::/5", "f800::/6", "fe00::/9",
)

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_QUAD = rf"{_OCTET}(?:\.{_OCTET}){{3}}"
_PART = r"(?:0x[0-9a-f]+|[0-9]+)"


def _any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def _quad_number(text: Column) -> Column:
    octets = F.transform(F.split(text, r"\."), lambda o: o.try_cast("long"))
    return F.aggregate(octets, F.lit(0).cast("long"), lambda total, o: total * 256 + o)


def _loose_number(host: Column) -> Column:
    """Old forms that name resolvers read: one to four decimal, octal (0...) or hex (0x...) parts, the last one filling the rest."""
    parts = F.transform(
        F.split(host, r"\."),
        lambda p: F.when(F.startswith(p, F.lit("0x")), F.conv(F.substring(p, 3, 20), 16, 10)).when(p.rlike("^0[0-7]+$"), F.conv(p, 8, 10)).when(p.rlike("^(0|[1-9][0-9]*)$"), p).try_cast("long"),
    )
    n, last = F.size(parts), F.element_at(parts, -1)
    leading = F.slice(parts, 1, n - 1)
    head = F.aggregate(leading, F.lit(0).cast("long"), lambda total, p: total * 256 + p)
    room = F.element_at(F.array(*[F.lit(256**k) for k in (4, 3, 2, 1)]), n)
    fits = F.forall(leading, lambda p: p.between(0, 255)) & (last >= 0) & (last < room)
    return F.when(fits, head * room + last)


def ipv4_number(host: Column) -> Column:
    """An IPv4 literal as a number; NULL for anything else."""
    loose = F.rlike(host, F.lit(rf"^{_PART}(?:\.{_PART}){{0,3}}$"))
    return F.when(F.rlike(host, F.lit(f"^{_QUAD}$")), _quad_number(host)).when(loose, _loose_number(host))


def ipv6_halves(host: Column) -> Column:
    """Struct of the halves (``hi``, ``lo``) of a bracketed IPv6 literal, zone names left out; NULL for anything else."""
    text = F.regexp_extract(F.lower(host), r"^\[([0-9a-f:.]+)(?:%[^\]]+)?\]$", 1)
    tail = F.regexp_extract(text, rf":({_QUAD})$", 1)
    number = _quad_number(F.nullif(tail, F.lit("")))
    hexed = F.concat(F.lower(F.hex(F.shiftright(number, 16))), F.lit(":"), F.lower(F.hex(F.bitwise_not(F.lit(-65536)).cast("long").bitwiseAND(number))))
    text = F.when(tail == "", text).otherwise(F.concat(F.left(text, F.length(text) - F.length(tail)), hexed))
    sides = F.split(text, "::")
    groups = lambda side: F.when(side == "", F.array().cast("array<string>")).otherwise(F.split(side, ":"))
    left, right = groups(F.get(sides, F.lit(0))), groups(F.coalesce(F.get(sides, F.lit(1)), F.lit("")))
    n = F.size(left) + F.size(right)
    whole = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(F.lit(8) - n, F.lit(0))), right)
    good = F.when(F.size(sides) == 2, n <= 7).otherwise((F.size(sides) == 1) & (n == 8)) & F.forall(whole, lambda g: g.rlike("^[0-9a-f]{1,4}$"))
    half = lambda first: reduce(
        lambda a, b: a.bitwiseOR(b), [F.shiftleft(F.conv(F.get(whole, F.lit(first + i)), 16, 10).cast("long"), 48 - 16 * i) for i in range(4)]
    )
    return F.when(good, F.struct(half(0).alias("hi"), half(4).alias("lo")))


def _in_ipv4(number: Column, blocks) -> Column:
    def bounds(block: str) -> tuple[int, int]:
        address, bits = block.split("/")
        start = reduce(lambda total, o: total * 256 + int(o), address.split("."), 0)
        return start, start + 2 ** (32 - int(bits)) - 1

    return _any_of(number.between(*bounds(block)) for block in blocks)


def _prefix(block: str) -> list[tuple[int, int]]:
    """(mask, bits) of both halves as signed numbers."""
    address, bits = block.split("/")
    left, _, right = address.partition("::")
    groups = [[int(g, 16) for g in side.split(":") if g] for side in (left, right)]
    whole = groups[0] + [0] * (8 - len(groups[0]) - len(groups[1])) + groups[1]
    value = reduce(lambda total, g: total << 16 | g, whole, 0)
    mask = ((1 << 128) - 1) ^ ((1 << (128 - int(bits))) - 1)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return [(signed(mask >> s & (1 << 64) - 1), signed(value >> s & (1 << 64) - 1)) for s in (64, 0)]


def _in_ipv6(halves: Column, blocks) -> Column:
    def inside(block: str) -> Column:
        tests = [halves[half].bitwiseAND(F.lit(mask)) == F.lit(value) for half, (mask, value) in zip(("hi", "lo"), _prefix(block), strict=True) if mask]
        return reduce(lambda a, b: a & b, tests)

    return _any_of(inside(block) for block in blocks)


def ipv4_reason(number: Column, allow_private: bool = False) -> Column:
    """Why an IPv4 address must not be fetched; NULL when it may be."""
    metadata = F.when(_in_ipv4(number, IPV4_METADATA), "METADATA_IP")
    if allow_private:
        return metadata
    return (
        metadata.when(_in_ipv4(number, IPV4_LOOPBACK), "LOOPBACK")
        .when(_in_ipv4(number, IPV4_LINK_LOCAL), "LINK_LOCAL")
        .when(_in_ipv4(number, IPV4_MULTICAST), "MULTICAST")
        .when(_in_ipv4(number, IPV4_PRIVATE) & ~_in_ipv4(number, IPV4_PUBLIC), "PRIVATE_ADDRESS")
    )


def ipv6_reason(halves: Column, allow_private: bool = False) -> Column:
    """Why an IPv6 address must not be fetched; a mapped one is judged as the IPv4 address it holds."""
    mapped = F.when(_in_ipv6(halves, IPV6_MAPPED), halves["lo"].bitwiseAND(F.lit(0xFFFFFFFF)))
    held = ipv4_reason(mapped, allow_private)
    if allow_private:
        return held
    return (
        F.when(mapped.isNotNull(), held)
        .when(_in_ipv6(halves, IPV6_LOOPBACK), "LOOPBACK")
        .when(_in_ipv6(halves, IPV6_LINK_LOCAL), "LINK_LOCAL")
        .when(_in_ipv6(halves, IPV6_MULTICAST), "MULTICAST")
        .when(_in_ipv6(halves, IPV6_PRIVATE) & ~_in_ipv6(halves, IPV6_PUBLIC), "PRIVATE_ADDRESS")
        .when(_in_ipv6(halves, IPV6_RESERVED), "RESERVED")
    )
