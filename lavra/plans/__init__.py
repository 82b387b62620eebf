"""plans of lavra."""
