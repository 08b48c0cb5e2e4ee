"""Scalar functions as typed column expressions."""
