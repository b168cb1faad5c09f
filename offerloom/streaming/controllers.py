"""Controllers that feed back on themselves: where the screen is, and how bright it is taken.

``ScreenTracker`` weighs one candidate outline a check against the corners it holds and the
screen as it was calibrated.  ``AutoGain`` turns a measured brightness into the gain and the
exposure of the next frames.  Both are machines: tables fold them, streams keep their states.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import sqrt

from offerloom.functions.geometry import SHAPE_BAND, SIZE_BAND
from offerloom.streaming.machines import Machine, Values

Quad = list[float]  # x and y of the four corners: top left, top right, bottom right, bottom left

# Fixed values of the tracker: milliseconds between checks, checks that must agree, shares of a
# screen's own scale, and how long the corners may be wrong.
CHECK_MS, AGREE, CENTRE_AGREE = 400, 5, 2
SETTLE, NUDGE, JUMP, EASE = 0.06, 0.05, 0.22, 0.35
RECOVER_MS, STALL_MS, DISPUTE_MS, LOST = 30_000, 5_000, 2_000, 3


def corner(q: Quad, i: int) -> tuple[float, float]:
    return q[2 * i], q[2 * i + 1]


# These are asked several times of each row, so they call nothing but the root.


def apart(a: Quad, b: Quad) -> float:
    """Mean distance of corresponding corners."""
    (ax, ay, bx, by, cx, cy, dx, dy), (ex, ey, fx, fy, gx, gy, hx, hy) = a, b
    first, second = sqrt((x := ax - ex) * x + (y := ay - ey) * y), sqrt((x := bx - fx) * x + (y := by - fy) * y)
    return (first + second + sqrt((x := cx - gx) * x + (y := cy - gy) * y) + sqrt((x := dx - hx) * x + (y := dy - hy) * y)) / 4


def span(q: Quad) -> float:
    ax, ay, bx, by, cx, cy, dx, dy = q
    return (sqrt((x := ax - cx) * x + (y := ay - cy) * y) + sqrt((x := bx - dx) * x + (y := by - dy) * y)) / 2


def aspect(q: Quad) -> float:
    ax, ay, bx, by, cx, cy, dx, dy = q
    across = (sqrt((x := ax - bx) * x + (y := ay - by) * y) + sqrt((x := dx - cx) * x + (y := dy - cy) * y)) / 2
    down = (sqrt((x := ax - dx) * x + (y := ay - dy) * y) + sqrt((x := bx - cx) * x + (y := by - cy) * y)) / 2
    return down / max(across, 1.0)


def within(ratio: float, band: float) -> bool:
    return band <= ratio <= 1 / band


def near(a: Quad, b: Quad, share: float) -> bool:
    return apart(a, b) <= share * max(span(b), 1.0)


def holds(q: Quad, x: float, y: float) -> bool:
    """Whether a convex quad has a point inside or on its edge."""
    turns = []
    for i in range(4):
        (ax, ay), (bx, by) = corner(q, i), corner(q, (i + 1) % 4)
        turns.append((bx - ax) * (y - ay) - (by - ay) * (x - ax))
    return min(turns) >= 0 or max(turns) <= 0


@dataclass
class Corners:
    now: list | None = None
    calibrated: list | None = None


@dataclass
class Evidence:
    last: list | None = None  # the candidate of the check before
    agreeing: int = 0
    misses: int = 0


@dataclass
class Clocks:
    checked: int | None = None
    disputed: int | None = None  # since when a screen is seen beside the corners
    off: int | None = None  # since when the corners are not on what is seen
    stuck: int | None = None  # since when the same outline has been seen there
    stuck_on: list | None = None


@dataclass
class Counts:
    moves: int = 0
    jumps: int = 0
    rebaselines: int = 0
    centred: int = 0
    resets: int = 0


class ScreenTracker(Machine):
    """A row: ``quad`` (eight numbers, null if nothing was found), ``frame_width``, ``frame_height``, ``reset``.

    Says for each row what became of it: early, miss, calibrated (nothing was known), stalled,
    centred, refused, eased, waits, adopted, or reset; and the corners and clocks after it.
    """

    STATES = {"corners": Corners, "evidence": Evidence, "clocks": Clocks, "counts": Counts}
    OUT = (
        "rig long, ord long, verdict string, moved boolean, quad array<double>, agreeing long, misses long, lost boolean, stalled boolean, disputing boolean,"
        " moves long, jumps long, rebaselines long, centred long, resets long"
    )

    def begin(self, row: Values) -> None:
        self.corners = Corners(list(row["quad"]), list(row["quad"]))

    def step(self, row: Values) -> Iterator[Values]:
        before = self.corners.now
        verdict = self.judge(row)
        c, k, now = self.counts, self.clocks, row["ts_ms"]
        if verdict in ("stalled", "centred", "eased", "adopted"):
            c.moves += 1
            c.jumps += verdict != "eased"
            c.rebaselines += verdict == "stalled"
            c.centred += verdict == "centred"
        yield {
            "ord": row["ord"], "verdict": verdict, "moved": before is not None and verdict not in ("reset",) and self.corners.now is not before,
            "quad": self.corners.now, "agreeing": self.evidence.agreeing, "misses": self.evidence.misses, "lost": self.evidence.misses >= LOST,
            "stalled": k.off is not None and k.checked is not None and k.checked - k.off >= STALL_MS, "disputing": k.disputed is not None and now - k.disputed < DISPUTE_MS,
            "moves": c.moves, "jumps": c.jumps, "rebaselines": c.rebaselines, "centred": c.centred, "resets": c.resets,
        }

    def judge(self, row: Values) -> str:
        q, now = row["quad"], row["ts_ms"]
        if row["reset"]:
            return self._reset()
        if self.clocks.checked is not None and now - self.clocks.checked < CHECK_MS:
            return "early"
        self.clocks.checked = now
        if q is None:
            return self._miss()
        if self.corners.now is None:
            self.corners = Corners(q, q)
            return "calibrated"
        self._weigh(q, now)
        if self._is_stalled(q, now):
            return self._adopt(q, "stalled", calibrate=True)
        middle = row["frame_width"] / 2, row["frame_height"] / 2
        if self.evidence.agreeing >= CENTRE_AGREE and holds(q, *middle) and not holds(self.corners.now, *middle) and self._same_shape(q):
            return self._adopt(q, "centred", calibrate=True)
        if not (within(span(q) / max(span(self.corners.calibrated), 1.0), SIZE_BAND) and self._same_shape(q)):
            # what is refused is no evidence, neither of itself nor against the corners
            self.evidence, self.clocks.disputed = Evidence(), None
            return "refused"
        if not near(q, self.corners.now, JUMP):
            return self._adopt(q, "adopted") if self.evidence.agreeing >= AGREE else "waits"
        if self.evidence.agreeing >= AGREE or near(q, self.corners.now, NUDGE):
            self.corners.now = [a + (b - a) * EASE for a, b in zip(self.corners.now, q)]
            self._unstick()
            return "eased"
        return "waits"

    def _reset(self) -> str:
        self.corners.now = self.corners.calibrated
        self.evidence, self.clocks = Evidence(), Clocks(checked=self.clocks.checked)
        self.counts.resets += 1
        return "reset"

    def _miss(self) -> str:
        self.evidence = Evidence(misses=self.evidence.misses + 1)
        self.clocks = Clocks(checked=self.clocks.checked)
        return "miss"

    def _weigh(self, q: Quad, now: int) -> None:
        """How often the same was seen, and since when the corners are beside it."""
        e, k = self.evidence, self.clocks
        again = e.last is not None and near(q, e.last, SETTLE)
        self.evidence = Evidence(q, e.agreeing + 1 if again else 1)
        k.disputed = None if near(q, self.corners.now, JUMP) else now if k.disputed is None else k.disputed
        k.off = None if self._on(q) else now if k.off is None else k.off

    def _on(self, q: Quad) -> bool:
        return apart(q, self.corners.now) <= SETTLE * max(span(q), 1.0)

    def _same_shape(self, q: Quad) -> bool:
        return within(aspect(q) / max(aspect(self.corners.calibrated), 0.01), SHAPE_BAND)

    def _is_stalled(self, q: Quad, now: int) -> bool:
        """The same outline, of the screen's shape, seen beside the corners for too long.  Another shape is no word on it."""
        k = self.clocks
        if not self._same_shape(q):
            return False
        if self._on(q):
            self._unstick()
        elif k.stuck_on is None or not near(q, k.stuck_on, SETTLE):
            k.stuck_on, k.stuck = q, now
        else:
            return now - k.stuck >= RECOVER_MS
        return False

    def _unstick(self) -> None:
        self.clocks.stuck_on = self.clocks.stuck = self.clocks.off = None

    def _adopt(self, q: Quad, verdict: str, calibrate: bool = False) -> str:
        self.corners = Corners(q, q if calibrate else self.corners.calibrated)
        self.evidence.agreeing = 0
        self._unstick()
        return verdict


# Fixed values of the gain: brightness wanted, share of blown-out pixels borne, gain's step and limits, and
# exposures in microseconds that don't beat with a screen's dimming.
TARGET, TOLERANCE, CLIPPED, LIT = 205.0, 0.10, 0.08, 20.0
GAIN, STEP, LEAST_GAIN, MOST_GAIN, EVERY_MS = 1.5, 1.18, 1.0, 8.0, 6_000
EXPOSURES = (1042, 2083, 4167, 8333, 16667, 20000, 25000, 33333, 40000, 50000)


@dataclass
class Light:
    gain: float = GAIN
    exposure: int | None = None
    measured: int | None = None  # what was calibrated; never exceeded
    acted: int | None = None


@dataclass
class Turns:
    moves: int = 0
    shortened: int = 0


class AutoGain(Machine):
    """A row: ``bright``, ``clipped``, ``has_screen``.  Says which rule held, and gain and exposure after it.

    In this order: early, no picture, blown out (lower the gain, at its floor the exposure),
    exposure given back, no screen to aim at, near enough, gain raised or lowered; a gain at
    its limit is kept.
    """

    STATES = {"light": Light, "turns": Turns}
    OUT = "rig long, ord long, rule string, gain double, exposure long, moves long, shortened long"

    def begin(self, row: Values) -> None:
        self.light = Light(GAIN if row.get("gain") is None else row["gain"], row["exposure"], row["exposure"])

    def step(self, row: Values) -> Iterator[Values]:
        rule = self.judge(row)
        yield {"ord": row["ord"], "rule": rule, "gain": self.light.gain, "exposure": self.light.exposure, "moves": self.turns.moves, "shortened": self.turns.shortened}

    def judge(self, row: Values) -> str:
        x, bright = self.light, row["bright"]
        if x.acted is not None and row["ts_ms"] - x.acted < EVERY_MS:
            return "early"
        x.acted = row["ts_ms"]
        if bright <= 0:
            return "no picture"
        if row["clipped"] > CLIPPED:
            return "lowered" if self._set(x.gain / STEP) else "shortened" if self._shorten() else "blown out"
        if bright < TARGET and self._give_back(bright):
            return "given back"
        if not row["has_screen"] or bright < LIT:
            return "no screen"
        if abs(bright - TARGET) / TARGET <= TOLERANCE:
            return "near enough"
        return ("raised" if bright < TARGET else "lowered") if self._set(x.gain * (STEP if bright < TARGET else 1 / STEP)) else "kept"

    def _set(self, gain: float) -> bool:
        gain = max(LEAST_GAIN, min(MOST_GAIN, gain))
        if abs(gain - self.light.gain) < 0.01:
            return False
        self.light.gain = gain
        self.turns.moves += 1
        return True

    def _exposure(self, fits) -> bool:
        x = self.light
        some = [c for c in EXPOSURES if x.exposure is not None and fits(c)]
        if some:
            x.exposure = max(some)
        return bool(some)

    def _shorten(self) -> bool:
        shorter = self._exposure(lambda c: c < self.light.exposure)
        self.turns.shortened += shorter
        return shorter

    def _give_back(self, bright: float) -> bool:
        """A longer exposure, up to the measured one, if the picture it promises is not too bright."""
        x = self.light
        return x.measured is not None and self._exposure(lambda c: x.exposure < c <= x.measured and bright * c / x.exposure <= TARGET)
