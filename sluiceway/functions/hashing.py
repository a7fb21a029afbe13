"""Values that depend on a row's key only, so retries and repartitioning do not change them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sluiceway.functions.parsing import as_column


_NULL, _SEPARATOR = "\\N", "\x1f"


def _md5_int(*cols: Column | str, salt: str = "") -> Column:
    """First 32 bits of the md5 of the key columns as text; a null has a text of its own."""
    texts = [F.coalesce(as_column(c).cast("string"), F.lit(_NULL)) for c in cols]
    joined = texts[0] if len(texts) == 1 else F.concat_ws(_SEPARATOR, *texts)
    return F.conv(F.substring(F.md5(F.concat(joined, F.lit(salt))), 1, 8), 16, 10).cast("bigint")


def hash_bucket(*cols: Column | str, buckets: int, salt: str = "") -> Column:
    """Bucket 0 … buckets-1 from the first 32 bits of the md5 of the key as text and the salt.

    The value is the same in any engine that has md5. Give every purpose and seed its own salt:
    buckets with one salt are the same buckets, so one split would empty the parts of another.
    """
    return _md5_int(*cols, salt=salt) % F.lit(buckets)


def hash_fold(*cols: Column | str, k: int, seed: int = 42) -> Column:
    """Fold number from ``xxhash64``; the remainder is taken before ``abs``, which cannot overflow."""
    return F.abs(F.xxhash64(F.lit(f"fold{seed}"), *[as_column(c) for c in cols]) % F.lit(k)).cast("int")


def uniform(*cols: Column | str, seed: int = 42, portable: bool = False) -> Column:
    """A pseudo-random double in [0, 1) per key.

    ``portable`` takes the first 32 bits of md5 over all key columns (reproducible outside
    Spark); otherwise 53 bits of ``xxhash64`` over them. Null keys have a value, too.
    """
    if portable:
        return _md5_int(*cols, salt=f"#{seed}") / F.lit(float(2**32))
    h = F.xxhash64(F.lit(seed), *[as_column(c) for c in cols])
    return F.shiftrightunsigned(h, 11).cast("double") * F.lit(2.0**-53)
