"""Sources of the prose engine."""
