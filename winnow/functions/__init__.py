"""Column-level and frame-level building blocks shared by the operators."""
