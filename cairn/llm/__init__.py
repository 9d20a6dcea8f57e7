"""Training-data operators on text and vectors. Nothing outside of this subpackage imports it."""
