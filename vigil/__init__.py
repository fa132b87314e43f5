"""Risk-oversight jobs for AI interactions, on Spark."""
