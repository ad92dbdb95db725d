"""All queries of the library and their SQL."""

from weft.plans import aggregates, graphs, inputs, joining, kernels, ordered, projections, resampled, spatial, streams  # noqa: F401  each registers its queries
from weft.plans.fixtures import ORACLE_SQL, QUERIES  # noqa: F401
