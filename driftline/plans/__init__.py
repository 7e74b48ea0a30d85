"""All queries of the library."""

from ..queries import QUERIES, SQL
from . import exports, learning, records, samples, scoring, streams

__all__ = ["QUERIES", "SQL", "exports", "learning", "records", "samples", "scoring", "streams"]
