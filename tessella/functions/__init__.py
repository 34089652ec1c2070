"""Column functions shared by operators and sources."""
