"""Row-level flow features."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sluiceway.functions.parsing import as_column
from sluiceway.specs import FLOW_FLAG_MASKS, LOG_CEILING


def bucket_protocol(c: Column | str) -> Column:
    """tcp and udp kept, icmp* folded to icmp, arp and rarp to arp, anything else other."""
    name = F.lower(F.trim(as_column(c)))
    return (
        F.when(name.isin("tcp", "udp"), name)
        .when(name.startswith("icmp"), "icmp")
        .when(name.isin("arp", "rarp"), "arp")
        .otherwise("other")
    )


def bucket_port(c: Column | str) -> Column:
    """IANA range of a port number; null, unparsable or out-of-range ports are invalid.

    Text that is no decimal number, such as a hex port, counts as invalid by choice: calling it
    dynamic would put it among real port numbers.
    """
    port = as_column(c).try_cast("double")
    known = F.when(port <= 1023, "well_known").when(port <= 49151, "registered")
    return F.when((port >= 0) & (port <= 65535), known.otherwise("dynamic")).otherwise("invalid")


def flag_value(c: Column | str) -> Column:
    """Integer value of hex text (``0x`` optional); null, empty or too large gives null.

    Only the leading hex digits count, as in ``conv``. More than 16 significant digits
    would overflow ``conv``; the pattern matches nothing then.
    """
    text = F.replace(F.lower(F.trim(as_column(c))), F.lit("0x"), F.lit(""))
    digits = F.regexp_extract(text, "^0*([0-9a-f]{0,16})(?![0-9a-f])", 1)
    return F.conv(digits, 16, 10).try_cast("bigint")


def flag_bits(c: Column | str, masks: dict[str, int] | None = None) -> dict[str, Column]:
    """One 0.0 / 1.0 column per named bit mask of hex flag text."""
    value = F.coalesce(flag_value(c), F.lit(0))
    return {
        name: (value.bitwiseAND(F.lit(mask)) > 0).cast("double")
        for name, mask in (masks or FLOW_FLAG_MASKS).items()
    }


def safe_ratio(n: Column | str, d: Column | str) -> Column:
    """n / d where d > 0, else 0.0 (also for a null denominator)."""
    den = as_column(d)
    return F.when(den > 0.0, as_column(n) / den).otherwise(0.0)


def asymmetry(a: Column | str, b: Column | str) -> Column:
    """(a - b) / (a + b) where the sum is positive, else 0.0."""
    x, y = as_column(a), as_column(b)
    return safe_ratio(x - y, x + y)


def diff_sum(a: Column | str, b: Column | str) -> tuple[Column, Column]:
    """(a - b, a + b)."""
    x, y = as_column(a), as_column(b)
    return x - y, x + y


def duration_seconds(micros: Column | str) -> Column:
    """Microseconds to seconds; not positive or null gives 0.0."""
    us = as_column(micros)
    return F.when(us > 0.0, us / F.lit(1e6)).otherwise(0.0)


def clipped_log1p(c: Column | str, ceiling: float = LOG_CEILING) -> Column:
    """log1p of the value clipped to [0, ceiling]; null counts as 0.

    NaN sorts above every number in Spark, so it is clipped to the ceiling like +Inf.
    """
    floor = F.greatest(as_column(c), F.lit(0.0))
    return F.log1p(F.least(floor, F.lit(float(ceiling))))
