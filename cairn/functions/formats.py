"""Sizes, ratios and rates as text and numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _scaled(n: Column, units: tuple[str, ...], decimals: int, joint: str = " ") -> Column:
    """n in the largest unit in which it is 1 or more (the last one has no end); halves go to the even digit."""
    x = n.cast("double")
    out = None
    for k, unit in reversed(list(enumerate(units))):
        value = F.format_string(f"%.{decimals}f{joint}{unit}", F.bround(x / float(1024**k), decimals))
        out = value if out is None else F.when(x < float(1024 ** (k + 1)), value).otherwise(out)
    return out


def human_size(n: Column) -> Column:
    """Two decimals, B to PiB."""
    return _scaled(n, ("B", "KiB", "MiB", "GiB", "TiB", "PiB"), 2)


def human_size_short(n: Column) -> Column:
    """One decimal, B to TB, in steps of 1024."""
    return _scaled(n, ("B", "KB", "MB", "GB", "TB"), 1)


def pretty_size(n: Column) -> Column:
    """No decimals for bytes, one beyond."""
    x = n.cast("double")
    beyond = _scaled(n, ("B", "KB", "MB", "GB", "TB"), 1)
    return F.when(x == 0, "0 B").when(x < 1024, F.format_string("%.0f B", x)).otherwise(beyond)


def ratio_text(stored: Column, raw: Column) -> Column:
    """`0.125 (87.5% smaller)`; `n/a` where nothing was raw."""
    r = stored.cast("double") / raw.cast("double")
    return F.when(raw == 0, "n/a").otherwise(F.format_string("%.3f (%.1f%% smaller)", F.bround(r, 3), F.bround((F.lit(1.0) - r) * 100.0, 1)))


def throughput(n: Column, seconds: Column) -> Column:
    """Whole bytes a second; under a millisecond counts as one."""
    return F.floor(n.cast("double") / F.greatest(seconds.cast("double"), F.lit(0.001))).cast("long")


def percent(done: Column, total: Column) -> Column:
    """Whole percents, cut; null without a total."""
    return F.when(total > 0, F.floor(done.cast("decimal(38,0)") * 100 / total.cast("decimal(38,0)")).cast("long"))


def saturating_shift(n: Column, bits: Column) -> Column:
    """n times two to the power of bits (n and bits of at least 0), at most the largest long; in whole numbers throughout."""
    top = F.lit((1 << 63) - 1)
    k = F.when(bits > 63, 63).otherwise(bits).cast("int")  # from 63 on only 0 stays under the top, and a shift would begin again at 64
    return F.when(n <= F.call_function("shiftright", top, k), F.call_function("shiftleft", n, k)).otherwise(top)


def saving(stored: Column, raw: Column) -> Column:
    return F.when(raw > 0, F.lit(100.0) * (F.lit(1.0) - stored.cast("double") / raw.cast("double")))
