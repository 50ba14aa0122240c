"""Extension: the log as a stream."""
