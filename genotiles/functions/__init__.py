"""Column functions: DataFrame-free building blocks used by the operators."""
