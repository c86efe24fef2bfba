"""The queries of the library with their oracle SQL."""
