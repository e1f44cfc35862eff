from .alerts import (error_windows, sweep_error_counts,
                     alerts_batch_writer, error_alert_stream, error_rate_alerts, error_rate_stream,
                     event_time, run_error_alert_sweep, run_error_rate_alerts, stream_alerts_to_table,
                     wall_clock)
from .dedup import dedup_redeliveries, first_deliveries, sweep_deliveries
from .orphans import (OrphanState, orphan_conversations_live, orphan_conversations_stream, swept_orphans,
                      sweep_orphan_changes, sweep_orphan_conversations)

__all__ = ["error_windows", "sweep_error_counts", "first_deliveries", "sweep_deliveries",
           "alerts_batch_writer", "error_rate_alerts", "stream_alerts_to_table","error_alert_stream", "error_rate_stream", "event_time", "run_error_rate_alerts",
           "run_error_alert_sweep", "wall_clock", "dedup_redeliveries", "orphan_conversations_live",
           "orphan_conversations_stream", "swept_orphans", "sweep_orphan_conversations",
           "OrphanState", "sweep_orphan_changes"]
