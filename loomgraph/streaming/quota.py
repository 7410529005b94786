"""Sliding-window quotas: requests and tokens of the last minute, requests of the last day, and who may pass."""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.storage import fresh, fresh_many

MINUTE, DAY = 60_000_000, 86_400_000_000
#: Days in a bucket of time.
DAYS = 4


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp with or without zone."""
    return F.unix_micros(ts.cast("timestamp"))


def usage(events: DataFrame, key: str, tokens: Column) -> DataFrame:
    """``events`` (us) with rpm, tpm and rpd: requests and tokens of the last minute and requests of the last day, this one included. Rows without a time are left out.

    A row leaves when it is a minute or a day old: the windows are half open. What is in one is all that came so far without all that
    left, and both are read in order of time with one running figure each, so the work does not grow with the rows in a window.
    Time is cut into buckets of ``DAYS`` days, and a row of a bucket's last day is carried into the next one too, where it may still count. So a
    window partition is a part of a key's time instead of all it ever had.
    """
    rows = events.withColumn("tokens", F.greatest(tokens, F.lit(1)).cast("bigint")).where("us is not null")
    slot, own, after = fresh_many(3, *rows.columns)
    span = DAYS * DAY
    bucket = F.expr(f"cast((us - pmod(us, {span})) / {span} as bigint)")
    slots = F.when(F.expr(f"pmod(us, {span}) >= {span - DAY}"), F.array(bucket, bucket + 1)).otherwise(F.array(bucket))
    both = rows.withColumn(slot, F.explode(slots)).withColumn(own, F.col(slot) == bucket)
    in_order = Window.partitionBy(key, slot).orderBy("us")
    so_far = in_order.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    left = {n: in_order.rangeBetween(Window.unboundedPreceding, -n) for n in (MINUTE, DAY)}
    within = lambda m, n: m.over(so_far) - F.coalesce(m.over(left[n]), F.lit(0))
    used = both.withColumn(after, F.lead("us").over(in_order)).withColumns({
        "rpm": within(F.count("*"), MINUTE), "tpm": within(F.sum("tokens"), MINUTE), "rpd": within(F.count("*"), DAY),
        "oldest": F.coalesce(F.max(after).over(left[MINUTE]), F.min("us").over(so_far)),  # the one that follows the last that left
    })
    return used.where(own).drop(slot, own, after)


def capacity(used: DataFrame, rpm: int, tpm: int, rpd: int) -> Column:
    """0.6 x the share of free requests + 0.4 x the share of free tokens; 0 once the day's requests are used."""
    free = lambda limit, n: F.greatest(F.lit(0.0), (F.lit(limit) - F.col(n)) / F.lit(limit))
    return F.when(F.col("rpd") >= rpd, F.lit(0.0)).otherwise(F.round(0.6 * free(rpm, "rpm") + 0.4 * free(tpm, "tpm"), 6))


def wait_seconds(rpm: int) -> Column:
    """Seconds until the oldest request of the minute leaves and a tenth more, if the minute is full; else 0."""
    return F.when(F.col("rpm") < rpm, F.lit(0.0)).otherwise(F.round(F.greatest(F.lit(0.0), (F.col("oldest") + MINUTE - F.col("us")) / 1e6 + 0.1), 6))


def token_estimate(text: Column, extra: int = 200) -> Column:
    """A third of a text's characters, and ``extra``."""
    return F.floor(F.length(text) / 3) + extra


class Tracker:
    """What one key has used: the admitted requests and tokens that still count, and a cooldown."""

    def __init__(self, rpm: int, tpm: int, rpd: int):
        self.limits = (rpm, tpm, rpd)
        self.minute: deque[tuple[int, int]] = deque()
        self.day: deque[int] = deque()
        self.tokens, self.until = 0, 0

    def _drop(self, us: int) -> None:
        while self.minute and us - self.minute[0][0] >= MINUTE:
            self.tokens -= self.minute.popleft()[1]
        while self.day and us - self.day[0] >= DAY:
            self.day.popleft()

    def can(self, us: int, tokens: int) -> bool:
        """Whether a request of so many tokens may pass now."""
        self._drop(us)
        rpm, tpm, rpd = self.limits
        return us >= self.until and len(self.minute) < rpm and self.tokens + tokens <= tpm and len(self.day) < rpd

    def record(self, us: int, tokens: int) -> None:
        """Counts a request; it has one token at least."""
        self.minute.append((us, max(tokens, 1)))
        self.tokens += max(tokens, 1)
        self.day.append(us)

    def admit(self, us: int, tokens: int) -> bool:
        if not self.can(us, tokens):
            return False
        self.record(us, tokens)
        return True

    def cool(self, us: int, seconds: float = 6.0) -> None:
        self.until = us + int(seconds * 1e6)

    def failed(self, us: int, error: str) -> None:
        """Cools down after an error: a minute if a quota is used up, else ten seconds."""
        self.cool(us, 60.0 if "429" in error or "RESOURCE_EXHAUSTED" in error else 10.0)

    def capacity(self, us: int) -> float:
        """As ``capacity``; 0 while cooling."""
        self._drop(us)
        rpm, tpm, rpd = self.limits
        if us < self.until or len(self.day) >= rpd:
            return 0.0
        return 0.6 * max(0.0, (rpm - len(self.minute)) / rpm) + 0.4 * max(0.0, (tpm - self.tokens) / tpm)

    def wait(self, us: int) -> float:
        """Seconds until the cooldown ends, else until the minute has room."""
        self._drop(us)
        if us < self.until:
            return (self.until - us) / 1e6
        return 0.0 if len(self.minute) < self.limits[0] else max(0.0, (self.minute[0][0] + MINUTE - us) / 1e6 + 0.1)


class Router:
    """Sends requests to the model that has room: preferred ones first, then the greatest capacity, then the name.

    ``models``: name to (rpm, tpm, rpd); ``call``: (model, prompt) to (text, tokens). ``clock`` gives microseconds, ``sleep`` takes seconds.
    """

    def __init__(self, models: dict[str, tuple[int, int, int]], call: Callable[[str, str], tuple[str, int]], preferred: Callable[[str], bool] = lambda m: False, clock: Callable[[], int] | None = None, sleep: Callable[[float], None] = time.sleep):
        self.trackers = {m: Tracker(*limits) for m, limits in models.items()}
        self.call, self.preferred, self.sleep = call, preferred, sleep
        self.clock = clock or (lambda: time.time_ns() // 1000)

    def generate(self, prompt: str, extra: int = 200) -> str:
        """The text of the first call that succeeds, in at most two attempts a model.

        If the best model cannot take the request, the shortest wait is slept out; a failed call cools its model down.
        """
        estimate = len(prompt) // 3 + extra
        for _ in range(2 * len(self.trackers)):
            now = self.clock()
            model = min(self.trackers, key=lambda m: (not self.preferred(m), -self.trackers[m].capacity(now), m))
            tracker = self.trackers[model]
            if not tracker.can(now, estimate):
                wait = min(t.wait(now) for t in self.trackers.values())
                if wait > 0.1:
                    self.sleep(wait)
                    continue
            try:
                text, tokens = self.call(model, prompt)
            except Exception as e:  # the next attempt goes to a sibling
                tracker.failed(self.clock(), str(e))
                continue
            tracker.record(self.clock(), tokens)
            return text
        raise RuntimeError("no model could take the request")


def admissions(events: DataFrame, key: str, rpm: int, tpm: int, rpd: int) -> DataFrame:
    """(key, event_id, us, tokens, admitted): events in order, where only admitted ones count against the limits.

    What is admitted depends on what was, so this is a fold by key and no window. Keys are sorted into partitions and
    each is read in Arrow batches with one tracker, whose state is bounded by the limits, so a
    key with a third of the events takes time but no more memory than another. Equal times go by event_id.
    """
    rows = events.select(F.col(key).cast("string").alias("k"), "event_id", "us", F.col("tokens").cast("bigint").alias("tokens")).where("k is not null and us is not null")
    rows = rows.repartition("k").sortWithinPartitions("k", "us", "event_id")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, tracker = None, Tracker(rpm, tpm, rpd)
        for pdf in batches:
            passed = []
            for k, us, n in zip(pdf["k"], pdf["us"], pdf["tokens"]):
                if k != now:
                    now, tracker = k, Tracker(rpm, tpm, rpd)
                passed.append(tracker.admit(int(us), int(n)))
            yield pdf.assign(admitted=passed)[["k", "event_id", "us", "tokens", "admitted"]]

    out = rows.mapInPandas(fold, "k string, event_id bigint, us bigint, tokens bigint, admitted boolean")
    return out.withColumnRenamed("k", key)


def admission_stream(events: DataFrame, key: str, rpm: int, tpm: int, rpd: int) -> DataFrame:
    """``admissions`` of a stream (key, event_id, us, tokens): state is kept by key between batches; within a batch events are put in order.

    Events that come in a later batch than younger ones are judged at the later time, as a wall clock would.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(name, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tracker = Tracker(rpm, tpm, rpd)
        if state.exists:
            us, tokens, days = state.get
            tracker.minute = deque(zip(us, tokens))
            tracker.tokens, tracker.day = sum(tokens), deque(days)
        pdf = pd.concat(list(parts)).sort_values(["us", "event_id"])
        latest = tracker.day[-1] if tracker.day else 0
        passed = [tracker.admit(max(int(us), latest), int(n)) for us, n in zip(pdf["us"], pdf["tokens"])]
        state.update(([x for x, _ in tracker.minute], [n for _, n in tracker.minute], list(tracker.day)))
        yield pd.DataFrame({key: name[0], "event_id": pdf["event_id"], "us": pdf["us"], "tokens": pdf["tokens"], "admitted": passed})

    rows = events.select(F.col(key).cast("string").alias(key), "event_id", "us", F.col("tokens").cast("bigint").alias("tokens"))
    return rows.groupBy(key).applyInPandasWithState(step, f"`{key}` string, event_id bigint, us bigint, tokens bigint, admitted boolean", "us array<bigint>, tokens array<bigint>, days array<bigint>", "append", GroupStateTimeout.NoTimeout)


def upsert_last(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The last row of each combination of keys; rows with a null key are left out."""
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    last = Window.partitionBy(*keys).orderBy(*[F.col(o).desc() for o in order])
    rank = fresh(*rows.columns)
    return rows.withColumn(rank, F.row_number().over(last)).where(F.col(rank) == 1).drop(rank)


def pick(candidates: DataFrame, request: str, model: str, preferred: str) -> DataFrame:
    """(request, model) of each request: the preferred kind first, then the greatest capacity, then the name."""
    best = F.min_by(F.col(model), F.struct((~F.col(preferred)).alias("p"), (-F.col("capacity")).alias("c"), F.col(model).alias("m")))
    return candidates.where("capacity > 0").groupBy(request).agg(best.alias(model))
