"""Relations derived from tables, file readers and text sinks."""
