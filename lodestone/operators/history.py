"""Navigation history: a list with a cursor, folded over a session's events."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

#: Entries kept on each side of the cursor.
CAP = 100


@dataclass
class History:
    entries: list[str] = field(default_factory=list)
    cursor: int = -1

    def record(self, place: str | None) -> None:
        """Insert after the cursor, unless the place stands at the cursor (nothing happens) or just after it (the cursor moves on)."""
        if place is None:
            return
        if self.cursor >= 0 and self.entries[self.cursor] == place:
            return
        if not (0 <= self.cursor < len(self.entries) - 1 and self.entries[self.cursor + 1] == place):
            self.entries.insert(self.cursor + 1, place)
            self.cursor += 1
            self._trim()
        else:
            self.cursor += 1

    def step(self, by: int) -> str | None:
        """Go back (-1) or forward (1); null where there is nothing."""
        if not 0 <= self.cursor + by < len(self.entries):
            return None
        self.cursor += by
        self._trim()
        return self.entries[self.cursor]

    def apply(self, action: str, place: str | None, origin: str | None) -> str | None:
        if action == "back":
            return self.step(-1)
        if action == "forward":
            return self.step(1)
        self.record(origin)
        self.record(place)
        return place

    def _trim(self) -> None:
        first = max(0, self.cursor - CAP)
        self.entries = self.entries[first : self.cursor + CAP + 1]
        self.cursor -= first


RESULT = "session string, seq bigint, action string, at string, cursor bigint, size bigint"


def fold(events: DataFrame) -> DataFrame:
    """session, seq, action, at, cursor, size after each event; events: session, seq, action (jump, back, forward), place, origin.

    Sessions are dealt over tasks and sorted; a task holds one session's list
    (bounded by CAP) and cursor, however many events the session has.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        h, own = History(), None
        for pdf in batches:
            rows = []
            for session, seq, action, place, origin in pdf.itertuples(index=False):
                if own is None or session != own[0]:
                    h, own = History(), (session,)
                at = h.apply(action, place, origin)
                rows.append((session, seq, action, at, h.cursor, len(h.entries)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in RESULT.split(", ")])

    sorted_ = events.select("session", "seq", "action", "place", "origin").repartition("session").sortWithinPartitions("session", "seq")
    return sorted_.mapInPandas(run, RESULT)
