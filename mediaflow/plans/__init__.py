"""The registered queries; importing the modules fills the registry."""

from mediaflow.plans import arrays, keyed, models, pictures, records, sinks
from mediaflow.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "arrays", "keyed", "models", "pictures", "records", "sinks"]
