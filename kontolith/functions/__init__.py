"""Part of kontolith."""
