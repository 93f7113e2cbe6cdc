"""Point-in-time matchup analytics on Spark."""
