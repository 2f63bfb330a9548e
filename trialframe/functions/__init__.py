"""Scalar expressions, all on the JVM side unless their module says otherwise."""
