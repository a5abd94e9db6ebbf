"""Column-to-Column functions; nothing in here starts a job or leaves the JVM."""
