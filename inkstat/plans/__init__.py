"""Plans of the prose engine."""
