"""Sources, sinks and views over given tables."""
