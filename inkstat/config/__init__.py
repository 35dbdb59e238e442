"""Config of the prose engine."""
