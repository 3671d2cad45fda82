"""The library's queries; importing a module registers its queries."""

from tessera.plans import dashboard, diagnosis, extract, filters, graph, joins, more, rollups, scalars, scenario, search, streams
from tessera.plans.registry import QUERIES, SQL
