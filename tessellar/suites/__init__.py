"""suites of the engine."""
