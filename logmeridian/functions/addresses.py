"""Internet addresses as 16 bytes: one form for IPv4 (mapped into IPv6) and IPv6, to compare and to write."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

from logmeridian.functions.exprs import let

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_QUAD = rf"(?:{_OCTET}\.){{3}}{_OCTET}"
_GROUP = "[0-9a-f]{1,4}"
MAPPED = "0" * 20 + "ffff"


def _quad_hex(quad: Column) -> Column:
    return F.array_join(F.transform(F.split(quad, r"\."), lambda o: F.lpad(F.lower(F.hex(o.cast("int"))), 2, "0")), "")


def _groups(text: Column) -> Column:
    """The groups between single colons, as four digits each; an empty text has none."""
    return F.transform(F.filter(F.split(text, ":"), lambda g: g != ""), lambda g: F.lpad(g, 4, "0"))


def _six_hex(text: Column) -> Column:
    """32 digits of an IPv6 address without an embedded IPv4 address; null if it is none."""

    def joined(sides: Column) -> Column:
        left, right = _groups(sides[0]), _groups(F.coalesce(F.get(sides, F.lit(1)), F.lit("")))
        n = F.size(left) + F.size(right)
        filled = F.concat(F.array_join(left, ""), F.repeat(F.lit("0000"), 8 - n), F.array_join(right, ""))
        shape = text.rlike(rf"^(?:{_GROUP}(?::{_GROUP})*)?(?:::)?(?:{_GROUP}(?::{_GROUP})*)?$")
        return F.when(shape & F.when(F.contains(text, F.lit("::")), n <= 7).otherwise(n == 8), filled)

    return let(F.split(text, "::"), joined)


def address_hex(text: Column) -> Column:
    """32 lower-case digits of an address, IPv4 as its mapped form; null for anything else.

    Blanks around it, brackets, a zone (``%eth0``) and the case do not matter; an IPv4 address may stand at the end of an
    IPv6 one. Octets are decimal without leading zeros.
    """

    def parsed(t: Column) -> Column:
        tail = F.regexp_extract(t, rf":({_QUAD})$", 1)
        digits = let(tail, lambda q: F.when(q == "", t).otherwise(let(_quad_hex(q), lambda h: F.concat(F.regexp_replace(t, r"[0-9.]+$", ""), F.substring(h, 1, 4), F.lit(":"), F.substring(h, 5, 4)))))
        return F.when(t.rlike(rf"^{_QUAD}$"), F.concat(F.lit(MAPPED), _quad_hex(t))).when(F.contains(t, F.lit(":")), let(digits, _six_hex))

    plain = F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"^\[(.*)\]$", "$1"), "%.*$", "")
    return let(plain, parsed)


def address_bytes(text: Column) -> Column:
    """16 bytes of an address, which order and compare as the addresses do; null if ``text`` is none."""
    return F.unhex(address_hex(text))


def _compressed(digits: Column) -> Column:
    """Groups without leading zeros, the first of the longest runs of two or more zero groups as ``::``."""
    groups = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.regexp_replace(F.substr(digits, 4 * i + 1, F.lit(4)), "^0{1,3}", ""))

    def shortened(t: Column) -> Column:
        out = t
        for n in range(2, 9):  # the longest run is asked first
            run = "(?:^|:)0" + ":0" * (n - 1) + "(?::|$)"
            out = F.when(t.rlike(run), F.regexp_replace(t, f"^(.*?){run}(.*)$", "$1::$2")).otherwise(out)
        return out

    return let(F.array_join(groups, ":"), shortened)


def canonical_address(text: Column) -> Column:
    """One spelling for each address: dotted for IPv4 and mapped IPv4, compressed lower case for IPv6; null for what is none and for ``::``."""

    def written(h: Column) -> Column:
        octets = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.conv(F.substr(h, 25 + 2 * i, F.lit(2)), 16, 10))
        return F.when(h == "0" * 32, F.lit(None)).when(h.startswith(MAPPED), F.array_join(octets, ".")).when(h.isNotNull(), _compressed(h))

    return let(address_hex(text), written)


def mapped_text(text: Column) -> Column:
    """The canonical spelling with IPv4 in its mapped form, ``::ffff:10.0.0.1``; null for what is no address."""
    return let(canonical_address(text), lambda t: F.when(F.contains(t, F.lit(":")), t).otherwise(F.concat(F.lit("::ffff:"), t)))


def within(text: Column, network: str) -> Column:
    """Whether an address lies in ``network`` (an address and a number of bits); false for what is no address."""
    net = ipaddress.ip_network(network, strict=False)
    mapped = net.version == 4
    first = int(net.network_address) + (0xFFFF << 32 if mapped else 0)
    last = int(net.broadcast_address) + (0xFFFF << 32 if mapped else 0)
    return F.coalesce(address_hex(text).between(f"{first:032x}", f"{last:032x}"), F.lit(False))
