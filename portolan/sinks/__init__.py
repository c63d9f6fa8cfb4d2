"""Writers: Parquet, reports, deliveries, event log, session log."""
