"""Stream against static table."""
