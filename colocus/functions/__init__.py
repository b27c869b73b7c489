"""Column functions and numerical functions."""
