"""What callers can be told is wrong."""


class SearchError(Exception):
    """Base of this package's errors."""


class NamespaceNotFound(SearchError):
    pass


class NamespaceExists(SearchError):
    pass


class ShardNotFound(SearchError):
    pass


class NodeNotFound(SearchError):
    pass


class NodeExists(SearchError):
    pass


class PlacementError(SearchError):
    pass


class IndexClosed(SearchError):
    pass


class CorruptIndex(SearchError):
    pass


class Conflict(SearchError):
    pass


class NoQuery(SearchError):
    pass


class PluginError(SearchError):
    pass
