"""Gates over the frames and readings of a rig, as machines: what to read, when to look again, what to trust and say."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from offerloom.operators.frames import AGREE, CHANGED, STILL
from offerloom.streaming.machines import Machine, Values

# Extra looks at a new card, and the slow beat while one stays in view, in seconds.
BURST_S, BURST_EVERY_S = 4.0, 0.5
BEAT_S, BEAT_GROWTH, BEAT_MOST_S = 2.5, 1.6, 12.0
AIM = 6
MISSES = 3


def after(seconds: float) -> int:
    """The first millisecond later than so many seconds."""
    return int(seconds * 1000) + 1


@dataclass
class Changed:
    changed: bool = False
    begun: bool = False


class MotionGate(Machine):
    """``read``: a frame that is still after a change, once for each change; a rig's first frame is a change."""

    STATES = {"gate": Changed}
    OUT = "rig long, ord long, read boolean"

    def step(self, row: Values) -> Iterator[Values]:
        moved, still = row["diff"] > CHANGED or not self.gate.begun, row["diff"] <= STILL
        read = self.gate.changed and still and not moved
        self.gate = Changed(moved or self.gate.changed and not read, True)
        yield {"ord": row["ord"], "read": read}


@dataclass
class Said:
    words: str | None = None
    times: int = 0


class Agreement(Machine):
    """``agreeing``: how many readings in a row say the same (no reading is one that says nothing); ``locked`` from two on."""

    STATES = {"said": Said}
    OUT = "rig long, ord long, agreeing long, locked boolean"

    def step(self, row: Values) -> Iterator[Values]:
        same = self.said.times > 0 and row["sig"] == self.said.words
        self.said = Said(row["sig"], self.said.times + 1 if same else 1)
        yield {"ord": row["ord"], "agreeing": self.said.times, "locked": self.said.times >= AGREE}


@dataclass
class Page:
    words: str | None = None
    agree: int = 0
    missed: int = 0
    lock: bool = False


class PageLock(Machine):
    """The lock of a page: whole readings in a row that say the same; a few misses in a row begin anew."""

    STATES = {"page": Page}
    OUT = "rig long, ord long, agree long, lock boolean"

    def step(self, row: Values) -> Iterator[Values]:
        p = self.page
        if row["complete"]:
            agree = p.agree + 1 if p.words is not None and row["sig"] == p.words else 1
            self.page = Page(row["sig"], agree, 0, agree >= AGREE and bool(row["whole"]))
        else:
            self.page = Page() if p.missed + 1 == MISSES else Page(p.words, p.agree, p.missed + 1, p.lock)
            self.page.missed = p.missed + 1
        yield {"ord": row["ord"], "agree": self.page.agree, "lock": self.page.lock}


class Aim(Machine):
    """``aimed``: the last six readings were good."""

    STATES = {"said": Said}
    OUT = "rig long, ord long, aimed boolean"

    def step(self, row: Values) -> Iterator[Values]:
        self.said = Said(None, self.said.times + 1 if row["good"] else 0)
        yield {"ord": row["ord"], "aimed": self.said.times >= AIM}


@dataclass
class Spoken:
    pay: float | None = None
    minutes: float | None = None
    spoke: bool = False


class SpeakOnce(Machine):
    """``speak``: a locked, whole, ready reading that differs from what was spoken last; forgotten when nothing is ready."""

    STATES = {"spoken": Spoken}
    OUT = "rig long, ord long, speak boolean"

    def step(self, row: Values) -> Iterator[Values]:
        new = Spoken(row["pay"], row["minutes"], True)
        speak = bool(row["ready"] and row["locked"] and row["whole"]) and new != self.spoken
        if speak:
            self.spoken = new
        if not row["ready"]:
            self.spoken = Spoken()
        yield {"ord": row["ord"], "speak": speak}


@dataclass
class Burst:
    episode: int | None = None
    from_ms: int | None = None  # when it was armed; none if it is over
    last_ms: int | None = None


@dataclass
class Beat:
    words: str | None = None
    every: float = BEAT_S
    shown: bool = False
    seen_ms: int = 0
    last_ms: int | None = None


class Attention(Machine):
    """When to look again without a change in the picture: ``burst`` and ``beat``.

    A reading with pay arms four seconds of looks, once for each card; one that is whole and
    says what the one before said ends them.  While a card is in view there is a beat besides,
    which begins at once and slows down while readings say the same.
    """

    STATES = {"burst": Burst, "beat": Beat}
    OUT = "rig long, at_ms long, kind string"
    TIMED = True

    def step(self, row: Values) -> Iterator[Values]:
        if row["whole"] and row["stable"]:
            self.burst = Burst(last_ms=self.burst.last_ms)
        elif row["pay"] and row["episode"] != self.burst.episode:
            self.burst = Burst(row["episode"], row["ts_ms"], self.burst.last_ms)
        b = self.beat
        if row["sig"] is None:
            self.beat = Beat()
        else:
            same = b.shown and row["sig"] == b.words
            every = min(BEAT_MOST_S, b.every * BEAT_GROWTH) if same else BEAT_S
            self.beat = Beat(row["sig"], every, True, row["ts_ms"], b.last_ms)
        return iter(())

    def _burst_due(self) -> int | None:
        if self.burst.from_ms is None:
            return None
        at = self.burst.from_ms if self.burst.last_ms is None else max(self.burst.from_ms, self.burst.last_ms + after(BURST_EVERY_S))
        return at if at < self.burst.from_ms + BURST_S * 1000 else None

    def _beat_due(self) -> int | None:
        if not self.beat.shown:
            return None
        return self.beat.seen_ms if self.beat.last_ms is None else max(self.beat.seen_ms, self.beat.last_ms + after(self.beat.every))

    def due(self) -> int | None:
        return min((x for x in (self._burst_due(), self._beat_due()) if x is not None), default=None)

    def tick(self, at_ms: int) -> Iterator[Values]:
        if self._burst_due() == at_ms:
            self.burst.last_ms = at_ms
            yield {"at_ms": at_ms, "kind": "burst"}
        if self._beat_due() == at_ms:
            self.beat.last_ms = at_ms
            yield {"at_ms": at_ms, "kind": "beat"}


class ErrorLog(Machine):
    """Messages worth logging: each that differs from the row before; a success (null) clears."""

    STATES = {"said": Said}
    OUT = "rig long, ord long, message string"

    def step(self, row: Values) -> Iterator[Values]:
        new = row["message"] is not None and row["message"] != self.said.words
        self.said = Said(row["message"], self.said.times + new)
        if new:
            yield {"ord": row["ord"], "message": row["message"]}
