"""Column functions: they take and return columns, and stay in the JVM."""
