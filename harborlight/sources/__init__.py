"""Sources of the station engine."""
