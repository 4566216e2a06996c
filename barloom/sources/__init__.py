"""sources of the bar engine."""
