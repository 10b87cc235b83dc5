"""Card-payment event processing on Spark SQL and Structured Streaming."""
