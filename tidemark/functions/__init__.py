"""Column functions: lists, vectors, time, scalars. All of them stay inside the JVM."""
