"""DataFrame -> DataFrame operators (cleaning, joins, statistics, series, ranks, split)."""
