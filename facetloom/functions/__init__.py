"""Column expressions. All run inside the JVM, without Python workers."""
