"""Driver-side exceptions. Row-level failures are data (see ``functions.values.error_object``)."""


class UsageError(ValueError):
    """A parameter or input list the caller got wrong."""

    code = "USAGE_ERROR"
