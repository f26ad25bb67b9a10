"""Column helpers; everything here is a JVM-side expression."""
