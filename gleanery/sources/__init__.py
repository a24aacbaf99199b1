"""Sources (specs, pages, attempt logs) and sinks."""
