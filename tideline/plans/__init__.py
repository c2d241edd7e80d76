"""Whole runs: the engine, its reports, and the catalogue of registered queries."""
