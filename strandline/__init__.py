"""Part of strandline, an engine for timed records on Spark."""
