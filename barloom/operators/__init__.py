"""operators of the bar engine."""
