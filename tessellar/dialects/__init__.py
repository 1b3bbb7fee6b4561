"""dialects of the engine."""
