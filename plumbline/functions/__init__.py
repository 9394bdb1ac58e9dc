"""Column functions: everything here is a JVM expression, no Python per row."""
