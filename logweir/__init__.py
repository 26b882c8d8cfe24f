"""Log and container-metric analytics as plain Spark DataFrame functions."""
