"""Errors by what went wrong; `expected` ones are the caller's to handle."""


class EngineError(Exception):
    expected = True


class InvalidSchema(EngineError):
    """A query schema has an unknown keyword or a bad argument."""


class InvalidLimit(EngineError):
    pass


class InvalidRegularExpression(EngineError):
    pass


class InvalidSlug(EngineError):
    pass


class InvalidVersion(EngineError):
    pass


class InvalidPatch(EngineError):
    pass


class ElementAlreadyExists(EngineError):
    pass


class NoElement(EngineError):
    pass


class NoLinkTarget(EngineError):
    pass


class UnknownCardType(EngineError):
    pass


class UnknownRelationship(EngineError):
    pass


class SchemaMismatch(EngineError):
    pass


class PermissionsError(EngineError):
    pass


class BadResultSetSize(EngineError):
    pass


class QueryTimeout(EngineError):
    expected = False


class CacheError(EngineError):
    expected = False
