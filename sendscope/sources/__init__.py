from .readers import read_campaigns_json, read_conversations_json, read_logs_csv, read_processed
from .writers import export_csv, export_json_lines, read_alerts, write_alerts, write_processed
from .adapter import load_tables, campaigns_from_events, conversations_from_driver, logs_from_events

__all__ = [
    "read_campaigns_json", "read_conversations_json", "read_logs_csv", "read_processed",
    "write_processed", "export_csv", "export_json_lines", "read_alerts", "write_alerts",
    "load_tables", "campaigns_from_events", "conversations_from_driver", "logs_from_events",
]
