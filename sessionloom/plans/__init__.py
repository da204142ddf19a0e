"""Reports and whole builds composed from the operators."""
