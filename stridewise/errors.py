"""Errors of the package."""


class StridewiseError(Exception):
    """Base of the errors that name a cause in the data."""


class GeometryError(StridewiseError):
    """A geometry does not meet its contract."""


class LoadError(StridewiseError):
    """A file cannot be read as a trajectory or an area."""


class InputError(StridewiseError):
    """Arguments do not fit together."""


class SpeedError(StridewiseError):
    """Speeds do not cover the trajectory."""


class AccelerationError(StridewiseError):
    """Accelerations do not cover the trajectory."""


class ArgumentTypeError(TypeError):
    """An argument has the wrong type."""


class ArgumentValueError(ValueError):
    """An argument has a value out of its range."""


class ImmutableError(AttributeError):
    """An attribute of an immutable object was to be set."""


class UnavailableError(RuntimeError):
    """An optional library is missing."""
