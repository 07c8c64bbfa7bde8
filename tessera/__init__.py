"""Tessera: a PySpark-native engine for versioned item, evidence and event corpora.

Every operator is a function from DataFrames and explicit parameters to a
DataFrame. ``tessera.plans`` binds the operators to the test tables and pairs
each binding with an independent SQL statement.
"""
