"""Streaming of the station engine."""
