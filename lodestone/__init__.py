"""Lodestone: governed analytics and retrieval as Spark jobs."""
