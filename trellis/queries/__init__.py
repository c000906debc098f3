"""All queries of the core and the SQL that checks them."""

from trellis.queries import ingest, packed, search, streams, tables  # noqa: F401
from trellis.queries.registry import ORACLES, QUERIES

QUERIES.update(packed.QUERIES)
ORACLES.update(packed.ORACLES)
