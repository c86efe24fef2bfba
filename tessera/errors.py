"""What the library raises for a request that is wrong, by kind."""


class RequestError(ValueError):
    """``code``: SYNTAX, BINDINGS, CONSTRAINT, SCHEMA or RESOURCE_LIMIT."""

    code = "SYNTAX"


class BindingsError(RequestError):
    code = "BINDINGS"


class ConstraintError(RequestError):
    """Rows break a declared schema."""

    code = "CONSTRAINT"


class SchemaError(RequestError):
    """A name that is not there, or twice."""

    code = "SCHEMA"


class ResourceLimitError(RequestError):
    code = "RESOURCE_LIMIT"
