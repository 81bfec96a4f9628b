"""operators of the readiness engine."""
