"""Structured Streaming: windows and sessions, joins of two streams, keyed state with timers, and replays of tables."""

from lumenfold.streaming.windows import events_by_window

__all__ = ["events_by_window"]
