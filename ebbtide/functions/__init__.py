from ebbtide.functions.columns import (
    bucket_percent,
    cell_start,
    day,
    from_micros,
    micros,
    quarter_index,
    ratio,
    unused,
)

__all__ = ["bucket_percent", "cell_start", "day", "from_micros", "micros", "quarter_index", "ratio", "unused"]
