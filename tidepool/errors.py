"""What the library raises, by what the caller can do about it."""


class TidepoolError(Exception):
    pass


class ConfigError(TidepoolError, ValueError):
    """A configuration that cannot be compiled."""


class UnknownOperatorError(ConfigError):
    pass


class StateError(TidepoolError):
    """A stored run that does not fit what is asked of it."""


class BackendError(TidepoolError):
    pass


class NameConflictError(TidepoolError, ValueError):
    pass


class NotFoundError(TidepoolError, LookupError):
    pass


class AuthorizationError(TidepoolError, PermissionError):
    pass


class ConflictError(TidepoolError):
    """The branch has moved since the base was read."""


class ValidationError(TidepoolError, ValueError):
    pass


class UnsafePathError(TidepoolError, ValueError):
    pass


class IntegrityError(TidepoolError):
    pass


class ModelError(TidepoolError):
    pass
