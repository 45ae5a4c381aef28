"""All queries of the engine and their SQL."""

from emberline.plans import correlation, measures, provenance
from emberline.plans.catalogue import ORACLES, QUERIES, flagship

__all__ = ["ORACLES", "QUERIES", "correlation", "flagship", "measures", "provenance"]
