"""Errors raised by loads."""


class IngestError(Exception):
    """A file cannot be loaded into its table."""
