"""Spark jobs for agent and reinforcement-learning run data."""
