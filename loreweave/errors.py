"""What can go wrong in a knowledge base."""


class KnowledgeBaseError(Exception):
    """Any error of this library."""


class ConfigurationError(KnowledgeBaseError):
    """A setting or name is unusable."""


class DatabaseError(KnowledgeBaseError):
    """Stored tables can't be read or written."""


class ConflictError(DatabaseError):
    """Another writer has published a version meanwhile."""


class FTSError(KnowledgeBaseError):
    """The full-text index can't be built."""


class ValidationError(KnowledgeBaseError, ValueError):
    """Data don't fit their schema."""


class InvalidTableNameError(ConfigurationError, ValueError):
    """A table name is not a plain identifier."""

    def __init__(self, name: str, why: str) -> None:
        super().__init__(f"Invalid table name {name!r}: {why}")


class GraphError(KnowledgeBaseError):
    """A graph query is malformed."""


class NodeNotFoundError(GraphError):
    """A node that a graph query names does not exist."""

    def __init__(self, node_type: str, node_id: object) -> None:
        super().__init__(f"Node not found: {node_type} {node_id!r}")


class InvalidDirectionError(GraphError, ValueError):
    """A direction is none of out, in and both."""

    def __init__(self, direction: str) -> None:
        super().__init__(f"Invalid direction {direction!r}: use out, in or both")
