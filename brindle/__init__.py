"""Brindle: security-data analytics and corpus preparation as Spark jobs."""
