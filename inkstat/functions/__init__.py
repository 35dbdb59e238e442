"""Functions of the prose engine."""
