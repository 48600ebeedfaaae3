"""Text pseudonymization, restoration and protection analytics as Spark plans."""
