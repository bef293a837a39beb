"""In-order overlap scan shared by the hot-video and the streaming form of de-duplication."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(slots=True)
class Kept:
    """One kept activity: its slot number, whether it was open before the scan, its span and text."""

    slot: int
    inherited: bool
    start: float
    end: float
    description: str | None


def text_length(text: str | None) -> int:
    """Code points; a missing text is as long as an empty one."""
    return len(text) if isinstance(text, str) else 0


def span_iou(a_start: float, a_end: float, b_start: float, b_end: float) -> float:
    shared = max(0.0, min(a_end, b_end) - max(a_start, b_start))
    union = (a_end - a_start) + (b_end - b_start) - shared
    return shared / union if union > 0 else 0.0


class OverlapScan:
    """Feeds on activities in (start, pos) order and holds only what a later start can still meet."""

    def __init__(self, threshold: float, live: list[Kept] | None = None):
        self.threshold = threshold
        self.live = live or []

    def push(self, new: Kept) -> bool:
        """Take in the next activity; True if it is kept in a slot of its own."""
        for old in self.live:
            if span_iou(new.start, new.end, old.start, old.end) > self.threshold:
                if text_length(new.description) > text_length(old.description):
                    old.start, old.end, old.description = new.start, new.end, new.description
                return False
        self.live.append(new)
        return True

    def settle(self, start: float) -> list[Kept]:
        """Remove and return what ends by ``start``: no later activity can overlap it."""
        done = [k for k in self.live if k.end <= start]
        if done:
            self.live = [k for k in self.live if k.end > start]
        return done
