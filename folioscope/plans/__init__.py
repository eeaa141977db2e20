"""Registered queries. Importing this package fills the registry."""

from folioscope.plans import chunking, documents, graph, maintenance, orphans, quality, resolution, search, streams  # noqa: F401
