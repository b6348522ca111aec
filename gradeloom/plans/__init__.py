"""Complete flows made of the operators."""
