"""seekgrain sources."""
