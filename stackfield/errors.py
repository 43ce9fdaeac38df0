"""Errors of the library."""


class StackfieldError(Exception):
    """Any error of the library."""


class EmptySequence(StackfieldError):
    """There are no frames."""


class InvalidSource(StackfieldError):
    """A file is not what it should be."""


class FrameIndexOutOfRange(StackfieldError):
    """No frame has that index."""


class InvalidCrop(StackfieldError):
    """A crop rectangle is empty or not within the frame."""


class PipelineError(StackfieldError):
    """A stage cannot go on."""
