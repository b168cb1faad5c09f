"""The card and offer machines over tables and streams, keyed by rig.

A table's rows are dealt by rig, sorted, and stream through a task, so a rig's record is never
held whole.  A stream keeps each rig's card and offer as two named states.  After a restart
without a checkpoint each rig's last journal row is handed over as initial state and says
where the rig goes on.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerloom.streaming.machines import Machine, Values, fold, live
from offerloom.streaming.merge import Card, Leg, Offer, identify, merge, resumed

EVENT = ["rig", "ord", "ts_ms", "pay", "minutes", "miles", "items", "deliver_by", "legs", "leg_detail", "miles_corrected", "shop", "settled", "locked"]
_NUMBERS = "pay double, minutes double, miles double, items double, deliver_by int, legs int"
MERGED = f"rig long, ord long, ts_ms long, {_NUMBERS}, merged_from int, episode long, new_card boolean, has_total boolean, grew boolean, miles_corrected boolean, miles_uncertain boolean, shop boolean, complete boolean"
JOURNAL = f"rig long, ord long, ts_ms long, offer_id string, seq int, first_ms long, settled boolean, {_NUMBERS}, shop boolean, has_total boolean, miles_uncertain boolean"
#: What of a rig's last journal row says where to go on.
LAST = ["ts_ms", "offer_id", "seq", "first_ms", "pay", "minutes", "miles", "items", "deliver_by", "has_total", "miles_uncertain"]


@dataclass
class Words:
    json: str | None = None


class Merging(Machine):
    """Readings to what each card's readings say together."""

    STATES = {"card": Words}
    OUT = MERGED

    def __init__(self) -> None:
        self.card = Card()

    def pack(self) -> dict[str, tuple]:
        return {"card": (json.dumps(asdict(self.card)),)}

    def unpack(self, held: dict[str, tuple]) -> None:
        if "card" in held:
            values = json.loads(held["card"][0])
            self.card = Card(**values | {"legs": [Leg(**x) for x in values["legs"]]})

    def step(self, row: Values) -> Iterator[Values]:
        self.card, merged = merge(self.card, row)
        yield merged


class Journal(Merging):
    """Readings to journal rows."""

    STATES = {"card": Words, "offer": Words, "last": Words}
    OUT = JOURNAL

    def __init__(self) -> None:
        super().__init__()
        self.offer: Offer | None = None
        self.last: Values | None = None

    def begin(self, row: Values) -> None:
        self.last = {name: row[name] for name in LAST}

    def pack(self) -> dict[str, tuple]:
        return super().pack() | {"offer": (self.offer and json.dumps(asdict(self.offer)),), "last": (self.last and json.dumps(self.last),)}

    def unpack(self, held: dict[str, tuple]) -> None:
        super().unpack(held)
        offer, last = (json.loads(held[name][0]) if held.get(name, (None,))[0] else None for name in ("offer", "last"))
        self.offer, self.last = offer and Offer(**offer), last

    def step(self, row: Values) -> Iterator[Values]:
        if self.offer is None:
            self.offer = resumed(self.last, row["ts_ms"]) if self.last else Offer()
        self.card, merged = merge(self.card, row)
        if merged["merged_from"] and merged["complete"] and row["locked"]:  # the gate: a whole offer that two readings agree on
            self.offer, written = identify(self.offer, merged)
            if written:
                yield written


def last_rows(last: DataFrame | None) -> DataFrame | None:
    """Each rig's last row of a journal."""
    if last is None:
        return None
    return last.groupBy("rig").agg(F.max_by(F.struct(*LAST), F.struct("ts_ms", "seq")).alias("r")).select("rig", "r.*")


def merge_batch(readings: DataFrame, journal: bool = False, last: DataFrame | None = None) -> DataFrame:
    """Merged readings (or journal rows) of a table of ``EVENT`` columns; ``last``: journal rows written before."""
    return fold(readings.select(*EVENT), Journal if journal else Merging, initial=last_rows(last) if journal else None)


def merge_stream(readings: DataFrame, journal: bool = False, last: DataFrame | None = None) -> DataFrame:
    """The same over a stream; ``last`` is handed to the state store once, not to every reading."""
    return live(readings.select(*EVENT), Journal if journal else Merging, last_rows(last) if journal else None)


def dedupe_stream(rows: DataFrame, key: str = "sync_key") -> DataFrame:
    """Rows of a stream whose key has not been seen; a copy may arrive any time later, so all keys stay in state.

    Of copies in one batch any stays; ``ingest.ingest`` keeps the first.
    """
    return rows.where(F.col(key).isNotNull()).dropDuplicates([key])
