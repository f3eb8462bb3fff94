"""Operators of a training-data pipeline over tables of documents and conversations.

Nothing else in the library imports this subpackage. Each operator takes DataFrames and returns
DataFrames; ``queries`` registers one query per operator.
"""
