"""Operators of the trajectory engine."""
