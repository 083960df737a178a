"""Named queries built from the operators, with their oracle SQL."""
