"""Column functions; all are JVM-side expressions unless their name says otherwise."""
