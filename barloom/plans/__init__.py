"""plans of the bar engine."""
