"""Every operator run over whole tables, each with an equivalent SQL text where one exists."""

from pairwright.workload import (  # noqa: F401
    augmenting, columns, evaluation, events, explaining, graphs, joins, matching, paging, rollups, sources, terms,
    texts,
)
from pairwright.workload.registry import QUERIES, SQL  # noqa: F401
