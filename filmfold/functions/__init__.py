"""Column-level building blocks; all but the fold-in solver are JVM expressions."""
