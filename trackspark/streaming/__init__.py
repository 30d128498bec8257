"""Streaming of the trajectory engine."""
