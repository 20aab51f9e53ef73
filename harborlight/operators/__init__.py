"""Operators of the station engine."""
