"""Column functions: record bytes, checksums, command lines, log frames."""
