"""Product-catalog analytics, price comparison and hybrid retrieval as Spark jobs."""
