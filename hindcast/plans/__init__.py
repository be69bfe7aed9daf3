"""Plans over the driver's tables: the panel mapping, the queries and their oracles."""
