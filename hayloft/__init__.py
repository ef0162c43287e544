"""hayloft: cataloguing and retrieval over large media collections, written as Spark DataFrame jobs."""
