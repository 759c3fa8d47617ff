"""Column functions: built-in Spark expressions only, so they stay inside the JVM."""
