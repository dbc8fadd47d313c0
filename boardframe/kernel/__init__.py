"""Chess rules in plain Python, called from Arrow batches only."""
