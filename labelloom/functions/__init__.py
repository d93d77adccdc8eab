"""Column expressions; every one stays on the JVM side."""
