"""kinweave: record linkage and family reconstitution on Spark."""
