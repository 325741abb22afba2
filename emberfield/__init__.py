"""Incident analytics on Spark DataFrames.

``functions``  pure column expressions
``operators``  DataFrame in, DataFrame out
``sources``    readers of landed files and writers of results
``plans``      end-to-end compositions (base table, features, profile, report, study)
``streaming``  the stateless part of the plans on a streaming DataFrame
"""
