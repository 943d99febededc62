"""File readers and writers that Spark has no format for."""
