"""Column helpers and the two Arrow jobs shared by the operators."""
