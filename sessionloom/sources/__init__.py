"""Reading the event export and writing tables."""
