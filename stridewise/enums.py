"""Choices that operators take."""

from __future__ import annotations

from enum import Enum, auto


class TrajectoryUnit(Enum):
    METER = 1
    CENTIMETER = 100


class SpeedCalculation(Enum):
    """What happens at the first and last frames of a pedestrian."""

    BORDER_EXCLUDE = auto()
    BORDER_ADAPTIVE = auto()
    BORDER_SINGLE_SIDED = auto()


class AccelerationCalculation(Enum):
    BORDER_EXCLUDE = auto()


class DataValidationStatus(Enum):
    DATA_CORRECT = auto()
    COLUMN_MISSING = auto()
    ENTRY_MISSING = auto()


class SpeedMethod(Enum):
    VORONOI = auto()
    ARITHMETIC = auto()
    MEAN = auto()
    GAUSSIAN = auto()


class DensityMethod(Enum):
    VORONOI = auto()
    CLASSIC = auto()
    GAUSSIAN = auto()


class RsetMethod(Enum):
    MAX = auto()
    MIN = auto()
    MEAN = auto()
