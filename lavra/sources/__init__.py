"""sources of lavra."""
