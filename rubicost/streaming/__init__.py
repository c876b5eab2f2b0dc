"""Streaming queries; importing this package registers them."""

from rubicost.streaming import log, stateful

__all__ = ["log", "stateful"]
