"""Relational and algorithmic operators of the encounter engine."""
