"""Training-data operators: one module per operator, nothing else in the library imports them."""
