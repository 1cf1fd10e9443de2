"""Column functions: tensors, text, JSON, and the registry of user functions."""
