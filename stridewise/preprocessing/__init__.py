"""Cleaning of trajectories."""
