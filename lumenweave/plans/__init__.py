"""The data model on the driver's tables and every query over it; importing this registers them all."""

from lumenweave.plans import assistant, catalog, communities, discovery, gold, payloads, queries, sampling, shaping, streams, structure  # noqa: F401
