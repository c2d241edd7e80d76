"""Readers and the first cleaning of what they read."""
