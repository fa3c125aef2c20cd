"""Catalog, competitor-price and catalog-quality analytics as Spark DataFrame jobs."""
