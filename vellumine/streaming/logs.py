"""Logs as streams: the same figures as the batch operators, kept up to date as files arrive."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from vellumine.operators import history

OBSERVATIONS = "asset_id string, predicted string, actual string, confidence double, in_distribution boolean, at timestamp"


def log_stream(spark: SparkSession, path: str, schema: str, files_a_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).json(path)


def unfamiliar_by_window(observations: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, n, unfamiliar) in tumbling windows; the watermark bounds the state."""
    w = observations.withWatermark("at", late).groupBy(F.window("at", window)).agg(F.count("*").alias("n"), F.count_if(~F.col("in_distribution")).alias("unfamiliar"))
    return w.select(F.col("window.start").alias("start"), "n", "unfamiliar")


def _last(rows: DataFrame, key: str, at: str) -> DataFrame:
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(at)).alias("r")).select(*(F.col(key) if c == key else F.col(f"r.{c}").alias(c) for c in rows.columns))


def latest_overrides(stream: DataFrame, target: str, checkpoint: str, key: str = "asset_id", at: str = "decided_at") -> StreamingQuery:
    """Keep the last override of each asset: every batch writes its own last ones as a version, which `current_overrides` puts over the earlier ones.

    A batch writes no more than it read, and one that runs again after a failure writes the same version again.
    """

    def merge(batch: DataFrame, number: int) -> None:
        _last(batch, key, at).write.mode("overwrite").parquet(f"{target}/version={number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_overrides(spark: SparkSession, target: str, key: str = "asset_id", at: str = "decided_at") -> DataFrame:
    """The last override of each asset over all versions."""
    return _last(spark.read.parquet(target).drop("version"), key, at)


def compact_overrides(spark: SparkSession, target: str, key: str = "asset_id", at: str = "decided_at") -> None:
    """Write the last overrides once more as a version before all others, so that earlier ones may be removed. Not while the stream runs."""
    current_overrides(spark, target, key, at).write.mode("overwrite").parquet(f"{target}/version=-1")


# --- the monitor as a stream ----------------------------------------------------------------------

#: Rows of the monitor's log: observations, or with `holdout_checks` a request to switch automation on again.
MONITORED = "model string, at long, predicted string, actual string, confidence double, in_distribution boolean, holdout_checks long"
#: Holdout checks that a request needs.
EVIDENCE = 3000
_STATE = "ats array<bigint>, strange array<boolean>, n bigint, wrong bigint, bin_n array<bigint>, bin_right array<bigint>, enabled boolean, reason string"
FIGURES = "model string, at bigint, rate double, n bigint, drift double, gap double, enabled boolean, reason string"


def monitored(observations: DataFrame) -> DataFrame:
    """FIGURES of each model after every batch that has rows of it, as `history.alarms` has them over all rows so far.

    A model's state is bounded: its last DRIFT_WINDOW rows by `at`, and counts. Automation that a figure has switched off stays off, whatever the figures do, until a request with enough
    holdout checks finds all of them within their limits; a request in a batch is looked at after the batch's observations. State survives restarts with the query's checkpoint.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ats, strange, n, wrong, bin_n, bin_right, enabled, reason = state.get if state.exists else ([], [], 0, 0, [0] * 10, [0] * 10, True, "")
        recent, checks = list(zip(ats, strange, strict=True)), None
        bin_n, bin_right = list(bin_n), list(bin_right)
        for frame in frames:
            asked = frame["holdout_checks"].dropna()
            checks = max([*([] if checks is None else [checks]), *asked.tolist()], default=None)
            rows = frame[frame["holdout_checks"].isna()]
            recent += [(int(a), not f) for a, f in zip(rows["at"], rows["in_distribution"], strict=True)]
            own = rows[rows["actual"].notna() & (rows["actual"] != "")]
            n += len(own)
            wrong += int((own["predicted"].isin(["trash", "safe_quarantine_candidate"]) & own["actual"].isin(["keep", "restored", "portfolio", "published"])).sum())
            edges = np.clip(np.round(own["confidence"].to_numpy(float) * 10), 0, 9).astype(int)
            for bin_, right in zip(edges.tolist(), (own["predicted"] == own["actual"]).tolist(), strict=True):
                bin_n[bin_] += 1
                bin_right[bin_] += right
        recent = sorted(recent)[-history.DRIFT_WINDOW :]
        rate = round(wrong / n, 5) if n else 0.0
        drift = round(sum(s for _, s in recent) / len(recent), 4) if recent else 0.0
        gap = round(max([abs(i / 10 - round(r / m, 4)) for i, (m, r) in enumerate(zip(bin_n, bin_right, strict=True)) if m >= history.BIN_LEAST], default=0.0), 4)
        problems = [text for bad, text in ((n >= history.BIN_LEAST and rate > history.FALSE_TRASH_ALARM, f"false-trash rate {rate:.3%} over {n} resolved cases"), (drift > history.DRIFT_ALARM, f"{drift:.0%} of recent frames are outside the model's experience"), (gap > history.CALIBRATION_ALARM, f"confidence is off by {gap:.2f} in its worst bin")) if bad]
        if problems:
            enabled, reason = False, "; ".join(problems)
        elif checks is not None and checks >= EVIDENCE:
            enabled, reason = True, ""
        state.update(([a for a, _ in recent], [s for _, s in recent], n, wrong, bin_n, bin_right, enabled, reason))
        yield pd.DataFrame({"model": [key[0]], "at": [recent[-1][0] if recent else 0], "rate": [rate], "n": [n], "drift": [drift], "gap": [gap], "enabled": [enabled], "reason": [reason]})

    return observations.groupBy("model").applyInPandasWithState(update, FIGURES, _STATE, "update", "NoTimeout")
