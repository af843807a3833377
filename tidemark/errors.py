"""Errors that the engine raises."""


class EngineError(Exception):
    """Base of all."""


class PartitionMismatch(EngineError):
    """A point lies outside the partition it was written to."""


class PartitionNotWritable(EngineError):
    """A partition is being flushed, or is dropping or dropped."""


class PartitionNotFound(EngineError):
    """A partition that was named does not exist."""


class CompactionError(EngineError):
    """Inputs of a compaction disagree on what a series is."""


class CorruptFile(EngineError):
    """Stored data cannot be read or fails its checksum."""


class QueryError(EngineError):
    """A query text cannot be understood."""
