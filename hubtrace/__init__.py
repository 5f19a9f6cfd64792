"""Event analytics around a hub of entities, written as Spark DataFrame plans.

``functions``  column expressions,
``operators``  DataFrame -> DataFrame building blocks,
``sources``    reading, typing, exporting tables,
``plans``      named queries assembled from the operators.
"""
