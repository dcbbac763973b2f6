"""Column functions on names, bases and qualities."""
