"""Operators on bars, panels and plans."""
