"""kinweave: record linkage, entity resolution and golden records, Spark first."""
