"""Sources and sinks: wide report files (CSV) and the Parquet fact store."""
