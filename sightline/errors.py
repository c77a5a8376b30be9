"""What the library raises."""


class SightlineError(Exception):
    """Base of all errors of this library."""


class ParameterError(SightlineError, ValueError):
    """A parameter is outside its range."""


class WidthError(SightlineError, ValueError):
    """Vectors that must have one width do not."""


class MissingBackendError(SightlineError, RuntimeError):
    """A runtime that a component needs is not installed."""


class ModelError(SightlineError, RuntimeError):
    """A model file cannot be loaded."""


class ExecutionError(SightlineError, RuntimeError):
    """A model failed while it ran."""


class TrackError(SightlineError, RuntimeError):
    """Frames of a camera are out of order, or a stream breaks its contract."""


class DetectorError(SightlineError, RuntimeError):
    """A detector's output cannot be used."""


def require(holds: bool, message: str) -> None:
    if not holds:
        raise ParameterError(message)
