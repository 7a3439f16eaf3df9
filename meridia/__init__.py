"""Map-data engine on Spark: sources, joins, dissolves, rules, audits and tiled outputs as DataFrame jobs."""
