"""Sources of spanloom."""
