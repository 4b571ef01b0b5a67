from ebbtide.streaming.activity import (
    read_events,
    run_to_end,
    stream_activity,
    stream_dedup,
    stream_enrich,
    stream_idle_alerts,
    stream_sessions,
)

__all__ = [
    "read_events",
    "run_to_end",
    "stream_activity",
    "stream_dedup",
    "stream_enrich",
    "stream_idle_alerts",
    "stream_sessions",
]
