"""Errors raised by the eager validations."""


class DataError(ValueError):
    """Input data or configuration breaks a rule; the message lists the offenders."""


class NoDatasetError(LookupError):
    """No registered dataset covers a region or area."""
