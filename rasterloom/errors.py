"""Errors with stable codes and HTTP statuses."""

from __future__ import annotations


class CubeError(Exception):
    """Base: ``code`` names the error for clients, ``status`` is its HTTP status."""

    status = 400

    @property
    def code(self) -> str:
        return type(self).__name__


class DimensionNotAvailable(CubeError):
    """A dimension with the given name does not exist."""


class DimensionExists(CubeError):
    """A dimension with the given name exists already."""


class DistinctDimensionLabelsRequired(CubeError):
    """Labels are not distinct."""


class LabelMismatch(CubeError):
    """The numbers of labels don't match."""


class LabelNotAvailable(CubeError):
    """A label does not exist."""


class LabelExists(CubeError):
    """A label exists already."""


class LabelsNotEnumerated(CubeError):
    """Labels to rename must be named when the dimension has none of its own."""


class TemporalExtentEmpty(CubeError):
    """The end of an extent is not after its start."""


class OverlapResolverMissing(CubeError):
    """Cubes overlap, but no resolver is given."""


class IncompatibleDataCubes(CubeError):
    """Cubes can't be aligned."""


class ProcessUnsupported(CubeError):
    """No process has this name."""

    status = 501


class ProcessParameterRequired(CubeError):
    """A parameter is missing."""


class ProcessParameterInvalid(CubeError):
    """A parameter has a wrong value."""


class FeatureUnsupported(CubeError):
    """A documented feature is not available here."""

    status = 501


class ItemsLimitExceeded(CubeError):
    """More items match than may be loaded."""


class OutputLimitExceeded(CubeError):
    """The cube would have too many pixels."""


class NoDataAvailable(CubeError):
    """Nothing matches."""


class NoTileAvailable(CubeError):
    """Every tile in range is taken."""


class TileNotAssigned(CubeError):
    """The user holds no tile of this service."""


class TileAlreadyLocked(CubeError):
    """A submitted tile can't be changed."""


class TileOutsideBounds(CubeError):
    """The tile does not meet the service's extent."""


class NotFound(CubeError):
    """No stored object has this id."""

    status = 404
