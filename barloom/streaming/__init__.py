"""streaming of the bar engine."""
