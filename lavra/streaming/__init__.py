"""streaming of lavra."""
