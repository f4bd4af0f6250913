"""Column expressions (JVM-side, no UDFs)."""
