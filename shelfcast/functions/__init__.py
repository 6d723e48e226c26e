"""Column-expression helpers (all JVM-side Catalyst expressions)."""
