"""Typed errors; each names one way in which a request can't be met."""


class LatticeError(Exception):
    """Any error of this library."""


class InvalidArgument(LatticeError, ValueError):
    """A parameter is outside what the operator allows."""


class FutureSequence(LatticeError):
    """A snapshot was asked for that has not been committed yet."""


class SnapshotExpired(LatticeError):
    """A snapshot was asked for whose versions may have been pruned."""


class UnknownSnapshotTag(LatticeError, KeyError):
    """No snapshot has this label."""


class HistoricalDataUnavailable(LatticeError):
    """Edges and vectors exist in their current state only."""


class CellNotFound(LatticeError, KeyError):
    """There is no such cell, or it isn't valid at the time asked for."""


class SeamNotFound(LatticeError, KeyError):
    """There is no seam with this id."""


class SeamConflict(LatticeError):
    """A seam's ends can't change."""


class DerivationMismatch(LatticeError):
    """A facet was derived from other content than the cell has."""


class ScanLimit(LatticeError):
    """A budget ran out; ``partial`` holds what was found, where the operator returns parts."""

    def __init__(self, message: str, partial=None):
        super().__init__(message)
        self.partial = partial


class NoFreePlacement(LatticeError):
    """Every coordinate within the radius is taken."""


class DimensionMismatch(LatticeError, ValueError):
    """A vector has another length than those stored."""


class CursorConflict(LatticeError):
    """A consumer's cursor isn't where the caller thought, or would move back or past the head."""


class RejectedCell(LatticeError):
    """A validator or an invariant refused a cell."""


class IndexChanged(LatticeError):
    """Vectors changed while an index over them was built."""
