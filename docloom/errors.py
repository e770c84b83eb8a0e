"""Errors of the engine; each has the status name and the HTTP code a wire would use."""


class EngineError(Exception):
    status, http = "UNKNOWN", 500


class NotFound(EngineError):
    status, http = "NOT_FOUND", 404


class AlreadyExists(EngineError):
    status, http = "ALREADY_EXISTS", 409


class FailedPrecondition(EngineError):
    status, http = "FAILED_PRECONDITION", 400


class Aborted(EngineError):
    status, http = "ABORTED", 409


class InvalidArgument(EngineError):
    status, http = "INVALID_ARGUMENT", 400


class Unimplemented(EngineError):
    status, http = "UNIMPLEMENTED", 501


class Conflict(Aborted):
    """A write whose base version isn't the present one."""
