"""Sources and sinks: JSON-Lines files, parquet tables, and the adapters that
shape the driver's test tables into the review model."""
