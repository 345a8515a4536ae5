"""scorewright: essay-scoring analytics written as Spark DataFrame jobs.

Every operator is a plain ``DataFrame -> DataFrame`` function built from
Spark SQL expressions, joins, aggregates, windows or MLlib estimators.
"""

__version__ = "0.1.0"
