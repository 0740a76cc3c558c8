"""A knowledge-base analytics engine on Spark."""
