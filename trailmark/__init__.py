"""Spark operators for agent trajectories, geographic predictions and RL rollouts."""

__version__ = "0.1.0"
