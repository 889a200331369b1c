"""Scalar functions: every one is a Column expression that stays in the JVM."""
