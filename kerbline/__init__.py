"""kerbline: ride-hailing analytics as Spark DataFrame and Structured Streaming operators."""
