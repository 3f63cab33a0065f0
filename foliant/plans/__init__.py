"""Named queries of the engine with the SQL that states the same result."""
