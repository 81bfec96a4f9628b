"""functions of the readiness engine."""
