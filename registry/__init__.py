"""The queries of the driver contract: each a Spark plan over the given tables, most with equivalent SQL."""
