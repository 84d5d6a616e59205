"""Column builders: every function takes and returns columns, and stays within generated code."""
