"""Table analytics as plain DataFrame-to-DataFrame functions on Apache Spark."""
