"""Sources and sinks: raw traffic, the test fixture view, dimensions, artifacts."""
