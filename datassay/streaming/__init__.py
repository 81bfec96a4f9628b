"""streaming of the readiness engine."""
