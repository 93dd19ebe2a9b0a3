"""strake: a PySpark engine for ordering, partitioning and checking fixed-width records."""
