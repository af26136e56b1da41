"""Error taxonomy of ingestion."""


class ProcessingError(Exception):
    """Any failure while turning a source into chunks."""


class FileError(ProcessingError):
    """A file could not be read."""


class MetadataError(ProcessingError):
    """Metadata could not be built."""


class FrameError(ProcessingError):
    """A frame lacks what its pipeline needs."""


class RowError(FrameError):
    """One row could not be processed."""


class ChunkError(ProcessingError):
    """A text could not be chunked."""


class Conflict(Exception):
    """A stored row is not as its writer believed (HTTP 409)."""


class NotFound(Exception):
    """There is no such live row (HTTP 404)."""
