"""Complete workflows built from the operators."""
