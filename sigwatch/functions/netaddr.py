"""Addresses as native column expressions: IPv4 as numbers, both families as sortable keys."""

from __future__ import annotations

import ipaddress
from collections import defaultdict
from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

from sigwatch.constants import PRIVATE_BLOCKS, PUBLIC_EXCEPTIONS

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}\z"


_GROUP = "[0-9a-fA-F]{1,4}"
# All eight groups, or "::" with at most seven groups around it.
IPV6 = (rf"^(?:(?:{_GROUP}:){{7}}{_GROUP}"
        rf"|(?!(?:.*?{_GROUP}(?::|\z)){{8}})(?!.*::.*::)(?:{_GROUP}(?::{_GROUP})*)?::(?:{_GROUP}(?::{_GROUP})*)?)\z")


def bounds(cidr: str) -> tuple[int, int]:
    """First and last address of a network as integers."""
    net = ipaddress.ip_network(cidr)
    return int(net.network_address), int(net.broadcast_address)


def ip_to_long(ip: Column) -> Column:
    """Address as a number; null for text that is not a strict dotted quad."""
    ends = [F.substring_index(ip, ".", 2), F.substring_index(ip, ".", -2)]
    texts = [F.substring_index(e, ".", side) for e in ends for side in (1, -1)]
    a, b, c, d = [t.try_cast("int").cast("bigint") for t in texts]
    value = a * 16777216 + b * 65536 + c * 256 + d
    return F.when(ip.rlike(IPV4), value)


def within(number: Column, cidrs: list[str], most_blocks: int = 4096) -> Column:
    """Whether the number lies in any of a short fixed list of networks.

    Networks are cut to the size of the smallest one, so that one set lookup answers for
    all; where that takes too many blocks, there is one lookup per network size.
    """
    nets = [ipaddress.ip_network(c) for c in cidrs]
    finest = max(n.prefixlen for n in nets)
    if sum(2 ** (finest - n.prefixlen) for n in nets) <= most_blocks:
        nets = [block for n in nets for block in n.subnets(new_prefix=finest)]
    blocks: dict[int, list[int]] = defaultdict(list)
    for net in nets:
        spare = 32 - net.prefixlen
        blocks[spare].append(int(net.network_address) >> spare)
    tests = [F.shiftright(number, spare).isin(found) for spare, found in sorted(blocks.items())]
    return F.coalesce(reduce(or_, tests), F.lit(False))


def public_only(cidrs: list[str]) -> list[str]:
    """Networks of the list that hold public addresses."""
    return [c for c in cidrs if not ipaddress.ip_network(c).is_private]


def is_private(ip: Column) -> Column:
    number = ip_to_long(ip)
    return within(number, PRIVATE_BLOCKS) & ~within(number, PUBLIC_EXCEPTIONS)


def cidr_bounds(cidr: Column) -> tuple[Column, Column]:
    """First and last number of the network in a text column (``a.b.c.d/n``)."""
    address = ip_to_long(F.split_part(cidr, F.lit("/"), F.lit(1)))
    bits = F.split_part(cidr, F.lit("/"), F.lit(2)).try_cast("int")
    size = F.pow(F.lit(2.0), 32 - F.when(bits.between(0, 32), bits)).cast("bigint")
    low = address - address % size
    return low, low + size - 1


def ip_key(ip: Column) -> Column:
    """A text that sorts as the addresses of its family do: the family, then all hex digits.

    Null for text that is no well-formed address of either family.
    """
    def groups(part: Column) -> Column:
        return F.filter(F.split(part, ":"), lambda g: g != "")

    head, tail = groups(F.split_part(ip, F.lit("::"), F.lit(1))), groups(F.split_part(ip, F.lit("::"), F.lit(2)))
    # Without "::" the tail is empty and nothing is missing.
    missing = F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - F.size(head) - F.size(tail)))
    digits = F.array_join(F.transform(F.concat(head, missing, tail), lambda g: F.lpad(F.lower(g), 4, "0")), "")
    return (F.when(ip.rlike(IPV4), F.concat(F.lit("4"), F.lpad(F.lower(F.hex(ip_to_long(ip))), 8, "0")))
            .when(ip.rlike(IPV6), F.concat(F.lit("6"), digits)))


def number_key(number: Column) -> Column:
    """The key of an IPv4 address given as a number."""
    return F.concat(F.lit("4"), F.lpad(F.lower(F.hex(number)), 8, "0"))


def cidr_keys(cidr: Column) -> tuple[Column, Column]:
    """Keys of the first and last address of a network of either family; null if malformed."""
    key = ip_key(F.split_part(cidr, F.lit("/"), F.lit(1)))
    bits = F.split_part(cidr, F.lit("/"), F.lit(2)).try_cast("int")
    width = F.length(key) - 1
    bits = F.when(bits.between(0, 4 * width), bits)
    whole = F.floor(bits / 4).cast("int")
    # The digit that the network's border cuts, if any: its free bits become 0 or 1.
    free = F.pow(F.lit(2), 4 - bits % 4).cast("int")
    digit = F.conv(F.substr(key, whole + 2, F.lit(1)), 16, 10).cast("int")
    low = digit - digit % free
    cut = bits % 4 != 0

    def end(filler: str, value: Column) -> Column:
        start = F.concat(F.substr(key, F.lit(1), whole + 1), F.when(cut, F.lower(F.hex(value.cast("bigint")))).otherwise(F.lit("")))
        return F.rpad(start, width + 1, filler)
    return end("0", low), end("f", low + free - 1)
