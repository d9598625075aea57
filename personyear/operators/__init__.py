"""DataFrame operators: projections, joins, aggregates, linkage, turnover, survival."""
