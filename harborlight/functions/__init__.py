"""Functions of the station engine."""
