"""Column functions: tile algebra and geometry as native Spark expressions."""
