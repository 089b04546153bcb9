"""Column helpers: everything here maps Columns to Columns and stays in the JVM."""
