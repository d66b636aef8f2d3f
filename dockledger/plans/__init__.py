"""Named queries over the driver tables, each with the SQL it must agree with."""

from dockledger.plans import filing, ordering, receiving, runlogs, stores  # noqa: F401
from dockledger.plans.registry import REGISTRY

__all__ = ["REGISTRY"]
