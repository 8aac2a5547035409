"""Data quality, constraint checking and stream preparation on Apache Spark."""
