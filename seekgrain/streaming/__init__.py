"""seekgrain streaming."""
