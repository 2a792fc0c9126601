"""Training-data operators: one module for each of the ten, plus their queries."""
