"""Errors of the engine. Each codec has its own; the cause is chained."""


class EngineError(Exception):
    """Any error of this engine."""


class FormatError(EngineError):
    """Input or a value that a format can't hold."""


class JsonError(FormatError):
    pass


class CsvError(FormatError):
    pass


class RawError(FormatError):
    pass


class AvroError(FormatError):
    pass


class CborError(FormatError):
    pass


class MessagePackError(FormatError):
    pass


class ProtobufError(FormatError):
    pass


class TomlError(FormatError):
    pass


class YamlError(FormatError):
    pass


class Unimplemented(EngineError, NotImplementedError):
    """A feature that has a name but no implementation."""


class IllegalState(EngineError):
    """The surroundings lack something, such as a home directory."""
