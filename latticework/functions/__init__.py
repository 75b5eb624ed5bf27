"""Column functions for transforms."""
