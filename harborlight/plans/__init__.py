"""Plans of the station engine."""
