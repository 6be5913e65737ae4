"""Alert rules on a stream of metric samples (W4, N6, N7): keyed state that waits out a rule's
``for:`` and reports when it fires and when it ends.

A rule's true ticks are held until the watermark has passed them, so samples may come in any
order within ``delay`` and in any cut into batches; what is reported then follows from the ticks
alone. An alert fires at the first tick at which its condition has held for ``for_s`` seconds. It
ends when the watermark passes a tick that was not true, whether its sample said so or never came:
event-time timers see to that where no sample of the rule arrives.

State per rule: the true ticks after the watermark (at most ``delay`` / interval plus what is
ahead of it) and the bounds of the run of true ticks that is under way.

Samples later than ``delay`` are dropped, repeated ones change nothing, a NULL value is not true,
ticks before 1970 are not supported.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from riskflow.operators import monitor

SAMPLE = "metric string, interval_s int, tick timestamp_ntz, value double"
STATES = ("alertname string, severity string, service string, state string, active_start timestamp_ntz, "
          "firing_start timestamp_ntz, firing_end timestamp_ntz")
HELD = "pending array<bigint>, first bigint, last bigint, firing boolean"
RULE = ("name", "severity", "service", "for_s", "interval_s")


def alert_states(samples: DataFrame, rules: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Transitions of the rules over streamed samples (metric, interval_s, tick, value): one row when
    an alert starts firing, one more when it is resolved (``firing_end`` is its last true tick)."""
    # a sample that is not true still moves the watermark, so nothing is filtered before the state
    true = F.coalesce(monitor.condition(F.col("value"), F.col("op"), F.col("threshold")), F.lit(False))
    ticks = (samples.withColumn("at", F.col("tick").cast("timestamp")).withWatermark("at", delay)
             .join(rules, ["metric", "interval_s"])
             .select(*RULE, "at", true.alias("true"), F.floor(monitor.epoch_us("tick") / (F.col("interval_s") * F.lit(1_000_000))).alias("k")))
    return ticks.groupBy(*RULE).applyInPandasWithState(_advance, STATES, HELD, "append", GroupStateTimeout.EventTimeTimeout)


def _advance(rule: tuple, samples: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    name, severity, service = rule[:3]
    for_s, interval_s = (int(x) for x in rule[3:])                  # they come as 32-bit numbers
    pending, first, last, firing = state.get if state.exists else ([], None, None, False)
    pending = set(pending)
    for s in samples:
        pending.update(int(k) for k in s.loc[s["true"], "k"])
    done = state.getCurrentWatermarkMs() // (interval_s * 1000)       # the last tick that no sample can change
    out = []

    def when(k: int, seconds: int = 0) -> pd.Timestamp:
        return pd.Timestamp(k * interval_s + seconds, unit="s")

    def tell(kind: str, end=None) -> None:
        out.append((name, severity, service, kind, when(first), when(first, for_s), end))

    for k in sorted(k for k in pending if k <= done):
        if last is not None and k > last + 1:
            if firing:
                tell("resolved", when(last))
            last = None
        if last is None:
            first, firing = k, False
        last = k
        if not firing and (last - first) * interval_s >= for_s:
            firing = True
            tell("firing")
    if last is not None and last < done:
        if firing:
            tell("resolved", when(last))
        first, last, firing = None, None, False

    pending = sorted(k for k in pending if k > done)
    ahead = pending[:1] + ([last + 1] if last is not None else [])
    if ahead:
        state.update((pending, first, last, firing))
        state.setTimeoutTimestamp(min(ahead) * interval_s * 1000)
    elif state.exists:
        state.remove()
    if out:
        frame = pd.DataFrame(out, columns=["alertname", "severity", "service", "state", "active_start", "firing_start", "firing_end"])
        yield frame.astype({"firing_end": "datetime64[ns]"})


def start(samples: DataFrame, rules: DataFrame, out: str, checkpoint: str, delay: str = "10 minutes", available_now: bool = True,
          processing_time: str | None = None):
    """Append the transitions to the table ``out`` (each once: the file sink's log leaves out what a
    lost batch wrote). ``available_now`` drains what is there and stops."""
    w = alert_states(samples, rules, delay).writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time or "10 seconds")
    return w.start()


def resolved(states: DataFrame) -> DataFrame:
    """Alerts that have ended, with the columns of ``monitor.alert_intervals``."""
    return states.where("state = 'resolved'").drop("state")


def firing(states: DataFrame) -> DataFrame:
    """Alerts that fire now: started and not resolved yet."""
    alert = ["alertname", "severity", "service", "active_start", "firing_start"]
    ended = F.count_if(F.col("state") == "resolved")
    return states.groupBy(*alert).agg(ended.alias("ended")).where("ended = 0").drop("ended")
