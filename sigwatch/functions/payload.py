"""Payload bytes: hex text and byte-aligned signature search."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from sigwatch.constants import PAYLOAD_SIGNATURES

# Any byte except the line feed, in hex.
_ANY = "(?:0[0-9b-f]|[1-9a-f][0-9a-f])"


def signature_pattern(signatures: dict[str, str] = PAYLOAD_SIGNATURES) -> str:
    """One pattern for all signatures; matches start on whole bytes only."""
    options = "|".join(s.replace("..", _ANY) for s in signatures.values())
    return f"^(?:[0-9a-f][0-9a-f])*?(?:{options})"


def to_hex(content: Column) -> Column:
    return F.lower(F.hex(content))


def has_signature(hex_text: Column) -> Column:
    return F.coalesce(F.lower(hex_text).rlike(signature_pattern()), F.lit(False))
