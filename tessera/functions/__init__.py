"""The analyzer and the scores."""
