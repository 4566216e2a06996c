"""functions of the bar engine."""
