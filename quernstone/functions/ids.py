"""Deterministic identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the namespace of index points.
POINT_NAMESPACE = "6f1d5a3c-6b8e-5e2a-9a44-0f2c6f9c1b77"


def uuid5(name: Column, namespace: str = POINT_NAMESPACE) -> Column:
    """Version 5 UUID of a name: SHA-1 of namespace and name, with version and variant."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), name.cast("binary")))
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 2), 16, 10).cast("long").bitwiseAND(F.lit(0x3F)).bitwiseOR(F.lit(0x80))))
    cut = lambda a, n: F.substring(digest, a, n)
    return F.concat(cut(1, 8), F.lit("-"), cut(9, 4), F.lit("-5"), cut(14, 3), F.lit("-"), variant, cut(19, 2), F.lit("-"), cut(21, 12))
