"""Sources and sinks: text, CSV, Parquet, tables, vector text."""
