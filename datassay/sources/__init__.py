"""sources of the readiness engine."""
