"""Errors of the engine."""


class InvalidArg(ValueError):
    """An argument that is wrong whatever the items are; raised on the driver, before any item runs."""

    code = "InvalidArg"


class Fault(Exception):
    """Why one item cannot be processed; the message carries the cause alone."""


class ItemError(RuntimeError):
    """An item failed: ``item {index}: {op}: {cause}``."""

    def __init__(self, index: int, message: str):
        super().__init__(f"item {index}: {message}")
        self.index = index
