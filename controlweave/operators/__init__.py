"""DataFrame operators: name lineage, joins, populations, rules, groups, samples."""
