"""Reading and writing: delimited files, archives, tables, stages, metrics, models."""
