"""Area eligibility analytics as Spark DataFrame operators.

``functions``  column expressions (text, numbers, predicates, geometry)
``operators``  DataFrame -> DataFrame building blocks (dedupe, joins, spatial, aggregates, quality)
``sources``    readers and writers for the landed inputs
``plans``      the eligibility rules, the reports and the batch jobs
"""
