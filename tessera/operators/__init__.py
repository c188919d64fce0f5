"""Index building, search, ranking and metrics."""
