"""Identity as Column expressions; ids are hexadecimal strings."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from symgraph.plans.schema import EDGE_KINDS


def node_id(full_name: Column) -> Column:
    """Id of a symbol or node: the MD5 of its full name."""
    return F.md5(full_name)


def ordinal(kind: Column, names: list[str]) -> Column:
    """Ordinal of an enumeration's name, null if unknown."""
    return F.try_element_at(F.create_map(*chain.from_iterable((F.lit(n), F.lit(i)) for i, n in enumerate(names))), kind)


def edge_id(source: Column, target: Column, kind: Column) -> Column:
    """MD5 of both ends' bytes and the kind's ordinal as a little-endian 32-bit integer."""
    o = ordinal(kind, EDGE_KINDS)
    byte = F.lpad(F.hex(o.cast("long")), 2, "0")
    return F.md5(F.unhex(F.concat(source, target, byte, F.lit("000000"))))


def asset_id(prefix: str, *parts: Column) -> Column:
    """Id of an asset node: the first 16 bytes of a SHA-256 of prefix and parts."""
    return F.substring(F.sha2(F.concat_ws(":", F.lit(prefix), *parts), 256), 1, 32)


def text_hash(text: Column) -> Column:
    """Content hash of a chunk: base64 of the MD5."""
    return F.base64(F.unhex(F.md5(text)))


def file_hash(content: Column) -> Column:
    """Content hash of a file: base64 of the SHA-256."""
    return F.base64(F.unhex(F.sha2(content, 256)))
