"""What the library raises."""


class FoldsparkError(Exception):
    """Base of all errors of this library."""


class NoData(FoldsparkError):
    """An input without rows."""


class WrongDimensions(FoldsparkError):
    """Vectors of different lengths, or a number of dimensions that a method can't have."""


class UnknownOption(FoldsparkError, ValueError):
    """A name that no option has."""


class NeighboursTooFew(FoldsparkError, ValueError):
    """A neighbour table narrower than a parameter needs."""


class NoGraphEdges(FoldsparkError):
    """A graph without an edge between two nodes."""


class DegenerateRadii(FoldsparkError):
    """Local radii without variance, which can't be standardised."""


class TooLargeForOneTask(FoldsparkError):
    """More points than a dense, single-task method may take; a distributed or landmark method is meant."""


class NoSharedFolder(FoldsparkError):
    """A cluster whose session names no folder for intermediate tables."""
