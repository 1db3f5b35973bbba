"""quillspark: a PySpark-native engine for document catalogues.

Operators are plain functions from DataFrames to DataFrames; Catalyst plans the work.
"""
