"""Analytics over catalogs of self-describing image containers, as Spark jobs."""
