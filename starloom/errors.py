"""Exceptions of the library."""


class StarloomError(Exception):
    """Base of all."""


class SchemaError(StarloomError): ...


class GrainCompatibilityError(SchemaError): ...


class NaturalKeyError(SchemaError): ...


class SCDError(StarloomError): ...


class LoadError(StarloomError): ...


class StopStream(LoadError):
    """A stream that has had as many batches as it was to have."""


class KeyResolutionError(LoadError): ...


class MigrationError(StarloomError): ...


class DestructiveMigrationError(MigrationError): ...


class SemanticError(StarloomError): ...


class TransformTypeError(StarloomError): ...


class ContractError(StarloomError): ...
