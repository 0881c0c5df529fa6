"""Errors that callers can tell apart."""


class DataContractError(ValueError):
    """Input that an operator can't take: a missing field, a repeated key, an empty vocabulary."""
