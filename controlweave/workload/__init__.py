"""The registered queries, each beside the SQL that states its result."""
