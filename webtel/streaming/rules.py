"""Rules that change while a stream runs: read again between batches, with backoff, and a gate for their version."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webtel.functions.html import validate_rules
from webtel.functions.numbers import clamp, uniform_float

HOUR_MS = 3_600_000
#: How long until rules are read again: usually, and after a change, which another may soon follow.
USUAL_MS, FAST_MS = (8 * HOUR_MS, 24 * HOUR_MS), (HOUR_MS // 2, 2 * HOUR_MS)
#: The wait after a failure grows by this for each in a row, give or take a half, within these bounds.
STEP_MS, LEAST_MS, MOST_MS = 10_000, 3_000, 8 * HOUR_MS
#: The largest document, and how far ahead a stored time may be before the clock is known to have jumped.
MOST_BYTES, DRIFT_MS = 1 << 20, 300_000


@dataclass(frozen=True)
class Feed:
    """What is known of a rules document: its text, when it may be read again, failures in a row, and the last change."""

    text: str | None = None
    wait_until: int = 0
    failures: int = 0
    changed_at: int = 0
    read_at: int = 0

    @property
    def rules(self) -> dict | None:
        return json.loads(self.text) if self.text else None


def sound(feed: Feed, now: int) -> Feed:
    """The feed, or an empty one if its times are from the future."""
    ahead = max(feed.wait_until - max(USUAL_MS), feed.changed_at, feed.read_at)
    return Feed() if ahead >= now + DRIFT_MS else feed


def _drawn(spark: SparkSession, low: float, high: float, key: str) -> int:
    return int(spark.range(1).select(uniform_float(F.lit(key), low, high)).first()[0])


def polled(spark: SparkSession, path: str, feed: Feed, now: int) -> Feed:
    """The next state of a feed at a time; nothing is read before it may be.

    A document that is missing, too large, no JSON, too new or has unknown
    parts is a failure: the last good rules stay, and the wait grows with
    the failures in a row. The document is one small file, read through Spark.
    """
    feed = sound(feed, now)
    if now < feed.wait_until:
        return feed
    try:
        row = spark.read.format("binaryFile").load(path).where(F.col("length") <= MOST_BYTES).select("content").first()
        if row is None:
            raise ValueError("no rules document of allowed size")
        text = bytes(row.content).decode()
        rules = json.loads(text)
        if not isinstance(rules, dict):
            raise ValueError("rules are no object")
        validate_rules(rules)
    except Exception:  # whatever is wrong with it, the last good rules stay
        n = feed.failures + 1
        wait = _drawn(spark, n * STEP_MS / 1.5, n * STEP_MS * 1.5, f"{path}:{now}")
        wait = int(spark.range(1).select(clamp(F.lit(wait), LEAST_MS, MOST_MS)).first()[0])
        return Feed(feed.text, now + wait, n, feed.changed_at, now)
    changed = feed.text is not None and feed.text != text
    low, high = FAST_MS if changed else USUAL_MS
    return Feed(text, now + _drawn(spark, low, high, f"{path}:{now}"), 0, now if changed else feed.changed_at, now)


class RuledStream:
    """Batches of a stream handed to `use(batch, rules, number)` with the rules of their time; before any rules, batches wait for none and are skipped."""

    def __init__(self, path: str, use: Callable[[DataFrame, dict, int], None], clock: Callable[[], int]):
        self.path, self.use, self.clock, self.feed = path, use, clock, Feed()

    def __call__(self, batch: DataFrame, number: int) -> None:
        self.feed = polled(batch.sparkSession, self.path, self.feed, self.clock())
        rules = self.feed.rules
        if rules is not None:
            self.use(batch, rules, number)
