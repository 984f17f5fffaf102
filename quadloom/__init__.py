"""Quadloom: a Spark-native engine for RDF graph canonicalisation, leaning and crawl-scale data processing."""

__version__ = "0.1.0"
