"""Measures of live trajectories."""

from stridewise.streaming.crossings import live_crossings, live_first_crossings, live_n_t
from stridewise.streaming.drain import drained, replay
from stridewise.streaming.live import live_classic_density, live_density_profile, live_stay_intervals

__all__ = ["drained", "live_classic_density", "live_crossings", "live_density_profile", "live_first_crossings", "live_n_t", "live_stay_intervals", "replay"]
