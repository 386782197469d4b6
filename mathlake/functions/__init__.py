"""Column -> Column functions and staged DataFrame transforms; everything here stays in the JVM."""
