"""Compositions of operators that answer one business question end to end."""
