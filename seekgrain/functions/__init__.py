"""seekgrain functions."""
