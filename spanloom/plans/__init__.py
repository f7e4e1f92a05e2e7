"""Plans of spanloom."""
