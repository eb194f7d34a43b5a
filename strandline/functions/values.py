"""Value rules that several operators share: number texts, padding, digests, bounds, stream times, defaults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio_text(value: Column) -> Column:
    """Two digits after the point."""
    return F.format_string("%.2f", value)


def about_ms(value: Column) -> Column:
    """A duration as ``~12.3ms``."""
    return F.format_string("~%.1fms", value)


def percent_text(share: Column) -> Column:
    """A share as whole percent, ties to the even number."""
    return F.concat(F.bround(share * 100, 0).cast("int").cast("string"), F.lit("%"))


def padded(*columns: tuple[Column, int], gap: str = "  ") -> Column:
    """Texts side by side, each padded to its width; a longer text is never cut."""
    return F.format_string(gap.join(f"%-{width}s" for _, width in columns), *[c for c, _ in columns])


def digest(*parts: Column) -> Column:
    """Prefixed SHA-256 of the joined parts."""
    return F.concat(F.lit("sha256:"), F.sha2(F.concat(*parts), 256))


def clamped(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def stream_time(message_id: Column) -> Column:
    """Time part of a stream id ``time-sequence``."""
    return F.split_part(message_id, F.lit("-"), F.lit(1)).cast("bigint")


def older_than(as_of: Column, at: Column, seconds: int) -> Column:
    return F.unix_micros(as_of) - F.unix_micros(at) > F.lit(seconds * 1_000_000)


def filled(value: Column, default: str) -> Column:
    """The text, or the default where it is null or empty."""
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(default))
