"""What can go wrong, by kind."""


class TraceError(Exception):
    """Any error of this library."""


class ParseError(TraceError):
    """A trace file isn't what it should be."""


class InvalidTrace(TraceError):
    """A trace that can't be written or encoded as asked."""


class InvalidStore(TraceError):
    """A stored trace of an unknown version or with parts missing."""


class VerifyError(TraceError):
    """A reconstruction differs from its original."""


class UnknownTask(TraceError):
    """No analysis has this name, or it doesn't run on stored traces."""
