"""Large-scale training-data operators (text, vectors) kept apart from the rest of the library."""
