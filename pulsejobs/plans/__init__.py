"""Jobs that chain operators."""
