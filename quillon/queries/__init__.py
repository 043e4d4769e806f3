"""All queries of the engine's own operators; importing this registers them."""

from . import aggregation, functions, joins, lookups, more, recommend, services, statistics, storage, streams, vectors  # noqa: F401
