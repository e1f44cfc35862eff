"""The scheduled monitoring job: checks C1–C4 for one day into the alerts table.

Meant to run once a day (any scheduler); re-running a day replaces that day's
alerts, so retries are safe.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import checks
from ..sources.writers import read_alerts, write_alerts


def run_daily_checks(camp: DataFrame, conv: DataFrame, logs: DataFrame, ctas, as_of, alerts_path: str,
                     orphan_threshold: int = checks.DEFAULT_ORPHAN_THRESHOLD,
                     error_threshold: int = 10) -> DataFrame:
    """Run the four checks for the day before ``as_of`` and write the alerts.

    Template-date and version checks look at that day's dispatches; the
    orphan check at that day's conversations; the error rate at that day's
    log lines. Returns the alerts written (read back from the table).
    """
    day_end = as_of if isinstance(as_of, dt.date) else dt.date.fromisoformat(str(as_of))
    day_start = day_end - dt.timedelta(days=1)

    def on_day(df: DataFrame, col: str) -> DataFrame:
        ts = F.col(col)
        out = df.where((ts >= F.lit(dt.datetime.combine(day_start, dt.time()))) &
                       (ts < F.lit(dt.datetime.combine(day_end, dt.time()))))
        if "publish_date" in df.columns:  # staged tables: date derived from this column
            out = out.where(F.col("publish_date") == F.lit(day_start))
        return out

    day_camp = on_day(camp, "publish_time")
    alerts = checks.alerts(
        template_date=checks.check_template_date(day_camp),
        version=checks.check_version(day_camp),
        orphans=checks.check_orphan_sessions(conv, camp, ctas, day_end, orphan_threshold),
        error_rate=checks.error_rate_hourly(on_day(logs, "timestamp"), error_threshold))
    write_alerts(alerts, alerts_path, day_end)
    return (read_alerts(camp.sparkSession, alerts_path)
                .where((F.col("run_date") == F.lit(day_end)) & (F.col("run_id") == "checks")))
