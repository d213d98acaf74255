"""tempora: a Spark-first analytics engine for time-partitioned tables."""
