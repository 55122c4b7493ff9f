"""File scans, layouts and sinks."""
