"""Brightloom: document, evidence and event analytics as Spark jobs.

``sources`` reads and writes tables, ``functions`` builds column expressions, ``operators`` joins,
aggregates, ranks and links whole DataFrames, ``plans`` holds the registered queries with their SQL
oracles, ``streaming`` holds the Structured Streaming extension.
"""
