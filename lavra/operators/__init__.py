"""operators of lavra."""
