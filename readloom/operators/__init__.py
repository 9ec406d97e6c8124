"""Relational and grouped operators of the engine."""
