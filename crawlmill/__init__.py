"""Crawl-index analytics as declarative Spark jobs.

Every operator is a function from DataFrames to DataFrames. ``functions`` holds
column expressions, ``operators`` the relational steps, ``sources`` the table
readers and snapshot writers, ``plans`` the registered queries and
``streaming`` the Structured Streaming forms. The optional ``llm`` subpackage
holds the operators for training data; nothing here imports it.
"""
