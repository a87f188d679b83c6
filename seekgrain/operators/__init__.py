"""seekgrain operators."""
