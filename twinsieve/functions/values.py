"""Sizes, hashes and attribute bits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Attribute bits of files whose content is not stored locally.
ATTRIBUTE_OFFLINE = 0x1000
ATTRIBUTE_RECALL_ON_OPEN = 0x40000
ATTRIBUTE_RECALL_ON_DATA_ACCESS = 0x400000
COLD_MASK = ATTRIBUTE_OFFLINE | ATTRIBUTE_RECALL_ON_OPEN | ATTRIBUTE_RECALL_ON_DATA_ACCESS

# Size units, 1024-based, in ascending order.
SIZE_UNITS = ("KB", "MB", "GB", "TB", "PB")
_SIZE = r"(?i)^([0-9]+(?:\.[0-9]+)?)([KMGTP]B)?$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_cold(attributes: Column | str) -> Column:
    """Whether reading a file would fetch it from a remote tier."""
    return _col(attributes).bitwiseAND(F.lit(COLD_MASK)) != 0


def valid_md5(md5: Column | str) -> Column:
    return F.coalesce(F.rlike(_col(md5), F.lit("^[0-9A-Fa-f]{32}$")), F.lit(False))


def md5_hex(content: Column | str, limit: int = 0) -> Column:
    """Upper-case MD5 of a content column, or of its first ``limit`` bytes."""
    raw = _col(content).cast("binary")
    return F.upper(F.md5(F.substring(raw, 1, limit) if limit else raw))


def parse_size(text: Column | str) -> Column:
    """Bytes of a size text such as ``1.5MB``, rounded half to even; null when it is not one."""
    t = _col(text)
    number = F.regexp_extract(t, _SIZE, 1).try_cast("double")
    unit = F.upper(F.regexp_extract(t, _SIZE, 2))
    factor = F.lit(1.0)
    for power, name in enumerate(SIZE_UNITS, start=1):
        factor = F.when(unit == name, F.lit(float(1024**power))).otherwise(factor)
    size = F.rint(number * factor)
    return F.when(F.rlike(t, F.lit(_SIZE)) & (size < F.lit(2.0**63)), size.try_cast("bigint"))
