"""The retry state machine of analyses, as state with timers in a stream.

Events (document_id, evenement, instant) drive one small state for each document:

- ``tache`` queues a document that isn't queued yet (one task a document);
- ``echec`` of a task that is due counts a try: the document waits 5 s, then twice as long at each
  further try, and is given up at the third;
- ``reussi`` of a task that is due ends it.

An outcome that comes before its task is due is a stale report and changes nothing.  A wait is an
event-time timer: when the watermark passes its end the task is handed out again, without any event.
Events are folded in order of time whatever batch brings them (those of one instant: ``tache``, then ``echec``, then
``reussi``); a timer that ended before the next event fires before it.  So a stream gives what a fold over all events
gives, as long as no event is older than the watermark (rows of the watermark's own instant are late, so allow for more
than the spread of one instant over batches).

Each transition is a row: ``en_file``, ``attend`` (until ``instant``), ``reprise``, ``abandonne``, ``termine``.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from privlake.operators.catalog import BACKOFF, RETRIES

TRANSITIONS = "document_id string, etat string, essais int, instant timestamp"
#: State of a document: tries so far, and when its task is due, in microseconds.
STATE = "essais int, pret_le long, attend boolean"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_ORDER = {"tache": 0, "echec": 1, "reussi": 2}
State = tuple[int, int, bool] | None


def due(state: State, now: int) -> tuple[State, list[tuple[str, int, int]]]:
    """The state at ``now`` and the transition of a wait that has ended by then."""
    if state is not None and state[2] and state[1] <= now:
        return (state[0], state[1], False), [("reprise", state[0], state[1])]
    return state, []


def step(state: State, event: str, now: int) -> tuple[State, list[tuple[str, int, int]]]:
    """(new state, transitions) of an event at ``now`` (microseconds)."""
    state, out = due(state, now)
    if event == "tache" and state is None:
        return (0, now, False), [*out, ("en_file", 0, now)]
    if state is None or state[2] or event == "tache":
        return state, out
    if event == "reussi":
        return None, [*out, ("termine", state[0], now)]
    tries = state[0] + 1
    if tries >= RETRIES:
        return None, [*out, ("abandonne", tries, now)]
    until = now + BACKOFF * 1_000_000 * 2 ** (tries - 1)
    return (tries, until, True), [*out, ("attend", tries, until)]


def _frame(key: str, rows: list[tuple[str, int, int]]):
    import pandas as pd

    d = pd.DataFrame(rows, columns=["etat", "essais", "instant"])
    d.insert(0, "document_id", key)
    return d.astype({"instant": "datetime64[us]", "essais": "int32"})


def _ordered(events) -> list[tuple[str, int]]:
    """(event, microseconds) of a pandas frame, in order of time."""
    at = events["instant"].astype("datetime64[us]").astype("int64")
    rows = sorted(zip(at, events["evenement"].map(_ORDER), events["evenement"], strict=True))
    return [(e, t) for t, _, e in rows]


class Retries(StatefulProcessor):
    """One document's state machine; a timer for each wait."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("tache", STATE)

    def _load(self) -> State:
        return tuple(self.state.get()) if self.state.exists() else None

    def _store(self, old: State, new: State) -> None:
        if new is None:
            self.state.clear()
        elif new != old:
            self.state.update(new)
        # a timer fires once the watermark has passed its millisecond
        if old is not None and old[2] and (new is None or old[1] != new[1] or not new[2]):
            self.handle.deleteTimer(_millis(old[1]))
        if new is not None and new[2] and (old is None or old[1] != new[1]):
            self.handle.registerTimer(_millis(new[1]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd

        old = state = self._load()
        out = []
        for event, now in _ordered(pd.concat(rows)):
            state, more = step(state, event, now)
            out += more
        self._store(old, state)
        if out:
            yield _frame(key[0], out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        state = self._load()
        if state is not None and state[2] and _millis(state[1]) <= expiredTimerInfo.getExpiryTimeInMs():
            self.state.update((state[0], state[1], False))
            yield _frame(key[0], [("reprise", state[0], state[1])])

    def close(self) -> None:
        pass


def _millis(micros: int) -> int:
    return -(-micros // 1000)


def transitions(events: DataFrame, late: str = "0 seconds") -> DataFrame:
    """The transitions of a stream of events; the session's state store must be the one that keeps timers (``ROCKSDB``)."""
    known = events.where(F.col("evenement").isin(*_ORDER) & F.col("instant").isNotNull() & F.col("document_id").isNotNull())
    return known.withWatermark("instant", late).groupBy("document_id").transformWithStateInPandas(Retries(), TRANSITIONS, "Append", "eventTime")


def fold(events: DataFrame, until=None) -> DataFrame:
    """The same over a table of events, folded in order; waits that end by ``until`` (a datetime) are over."""
    last = None if until is None else int(until.timestamp() * 1_000_000)

    def run(key, pdf):
        state, out = None, []
        for event, now in _ordered(pdf):
            state, more = step(state, event, now)
            out += more
        if last is not None:
            out += due(state, last)[1]
        return _frame(key[0], out)

    known = events.where(F.col("evenement").isin(*_ORDER) & F.col("instant").isNotNull() & F.col("document_id").isNotNull())
    return known.groupBy("document_id").applyInPandas(run, TRANSITIONS)


def _last(log: DataFrame) -> DataFrame:
    """(document_id, x): each document's last transition."""
    # at one instant a wait ends before its task is handed out, and that before the task ends
    rank = F.when(F.col("etat").isin("abandonne", "termine"), 2).when(F.col("etat") == "attend", 0).otherwise(1)
    return log.groupBy("document_id").agg(F.max(F.struct("instant", rank.alias("r"), "etat", "essais")).alias("x"))


def waiting(log: DataFrame) -> DataFrame:
    """(document_id, essais, pret_le) of the queue that a log of transitions leaves: each document's last one, if it isn't an end."""
    d = _last(log)
    return d.where(~F.col("x.etat").isin("abandonne", "termine")).select("document_id", "x.essais", F.col("x.instant").alias("pret_le"))


def ended(log: DataFrame, until) -> DataFrame:
    """The transitions (``reprise``) that a log still lacks of waits that end by ``until`` (a column of one value).

    A watermark counts whole milliseconds and instants microseconds: a wait that ends in the watermark's last millisecond
    has no timer fired, though it is over.
    """
    over = _last(log).where((F.col("x.etat") == "attend") & (F.col("x.instant") <= until))
    return over.select("document_id", F.lit("reprise").alias("etat"), "x.essais", "x.instant")
