"""All public functions under one name each; arguments are keywords or in the order of their definitions."""

from __future__ import annotations

from stridewise.enums import AccelerationCalculation, DataValidationStatus, DensityMethod, RsetMethod, SpeedCalculation, SpeedMethod, TrajectoryUnit
from stridewise.functions import register_functions
from stridewise.model import AxisAlignedMeasurementArea, Cutoff, MeasurementArea, MeasurementLine, TrajectoryData, WalkableArea
from stridewise.operators.acceleration import individual_acceleration as compute_individual_acceleration
from stridewise.operators.acceleration import mean_acceleration_per_frame as compute_mean_acceleration_per_frame
from stridewise.operators.acceleration import voronoi_acceleration as compute_voronoi_acceleration
from stridewise.operators.density import classic_density as compute_classic_density
from stridewise.operators.density import intersecting_polygons as compute_intersecting_polygons
from stridewise.operators.density import line_density as compute_line_density
from stridewise.operators.density import passing_density as compute_passing_density
from stridewise.operators.density import voronoi_density as compute_voronoi_density
from stridewise.operators.flow import crossing_frames as compute_crossing_frames
from stridewise.operators.flow import flow as compute_flow
from stridewise.operators.flow import frame_range_in_area as compute_frame_range_in_area
from stridewise.operators.flow import line_flow as compute_line_flow
from stridewise.operators.flow import n_t as compute_n_t
from stridewise.operators.flow import time_distance_line as compute_time_distance_line
from stridewise.operators.line import is_individual_speed_valid, is_species_valid
from stridewise.operators.profiles import density_profile as compute_density_profile
from stridewise.operators.profiles import grid_cell_polygon_intersection_area as compute_grid_cell_polygon_intersection_area
from stridewise.operators.profiles import grid_cells as get_grid_cells
from stridewise.operators.profiles import profiles as compute_profiles
from stridewise.operators.profiles import rset_map as compute_rset_map
from stridewise.operators.profiles import speed_profile as compute_speed_profile
from stridewise.operators.profiles import to_grid
from stridewise.operators.spatial import pair_distribution_function as compute_pair_distribution_function
from stridewise.operators.speed import individual_speed as compute_individual_speed
from stridewise.operators.speed import line_speed as compute_line_speed
from stridewise.operators.speed import mean_speed_per_frame as compute_mean_speed_per_frame
from stridewise.operators.speed import passing_speed as compute_passing_speed
from stridewise.operators.speed import species as compute_species
from stridewise.operators.speed import voronoi_speed as compute_voronoi_speed
from stridewise.operators.validity import invalid_trajectory as get_invalid_trajectory
from stridewise.operators.validity import is_trajectory_valid
from stridewise.operators.voronoi import individual_voronoi_polygons as compute_individual_voronoi_polygons
from stridewise.operators.voronoi import neighbor_distance as compute_neighbor_distance
from stridewise.operators.voronoi import neighbors as compute_neighbors
from stridewise.preprocessing.outliers import detect_anomalies as detect_anomalies_in_trajectories
from stridewise.preprocessing.projection import correct_invalid_trajectories
from stridewise.sources.files import (
    load_trajectory,
    load_trajectory_from_crowdit,
    load_trajectory_from_hdf5,
    load_trajectory_from_pathfinder_csv,
    load_trajectory_from_pathfinder_json,
    load_trajectory_from_sqlite,
    load_trajectory_from_txt,
    load_trajectory_from_vadere,
    load_trajectory_from_viswalk,
    load_walkable_area_from_crowdit,
    load_walkable_area_from_hdf5,
    load_walkable_area_from_sqlite,
    load_walkable_area_from_vadere,
    write_trajectory_txt,
)

__all__ = [name for name in dir() if not name.startswith("_") and name != "annotations"]
