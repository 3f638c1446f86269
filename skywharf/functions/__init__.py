"""Scalar rules as Column expressions; all stay inside generated code."""
