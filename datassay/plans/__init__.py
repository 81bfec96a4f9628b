"""plans of the readiness engine."""
