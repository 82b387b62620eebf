"""functions of lavra."""
