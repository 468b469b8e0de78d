"""tessera: document indexing, hybrid retrieval and corpus preparation on Spark."""
