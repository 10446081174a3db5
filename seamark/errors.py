"""Request errors, one class per kind of failure a caller can act on."""


class SeamarkError(Exception):
    """Base class."""


class InvalidRequest(SeamarkError, ValueError):
    """The request itself is malformed (blank query, unknown option, too long)."""


class NotFound(SeamarkError, LookupError):
    """The file or job named by the request is not in the index."""


class DataIntegrityError(SeamarkError):
    """Stored rows break an invariant (for example two rows for one key)."""
