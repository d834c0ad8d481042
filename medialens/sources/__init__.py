"""Sources and sinks: CSV/parquet/JSON readers and writers, month partitions, API pages, HTML."""
