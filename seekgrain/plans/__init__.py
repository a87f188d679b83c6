"""seekgrain plans."""
