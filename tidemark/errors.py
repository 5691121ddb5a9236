"""What the engine raises."""

from __future__ import annotations


class TidemarkError(Exception):
    """Root of the engine's own errors."""


class StorageError(TidemarkError):
    """Stored files are missing, unreadable or of another format."""


class CorruptLogError(TidemarkError):
    """A complete log frame fails its checksum."""

    def __init__(self, message: str, offset: int = -1, expected: int = 0, actual: int = 0):
        super().__init__(message if offset < 0 else f"{message} at offset {offset}: checksum {actual:#010x}, expected {expected:#010x}")
        self.offset, self.expected, self.actual = offset, expected, actual

    def __reduce__(self):
        return CorruptLogError, (str(self),)


class ConflictError(TidemarkError):
    """A transaction met a newer commit of a key that it read or wrote."""

    def __init__(self, txn_id: int, key: str):
        super().__init__(f"transaction {txn_id} conflicts on key '{key}'")
        self.txn_id, self.key = txn_id, key


class StateError(TidemarkError, RuntimeError):
    """A call on something closed or ended."""
