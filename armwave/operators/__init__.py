"""DataFrame operators: filters, casts, audits, joins, waves, statistics, models."""
