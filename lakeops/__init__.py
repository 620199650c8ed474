"""lakeops: lakehouse workspace data operations as PySpark DataFrame jobs.

Every operator takes DataFrames and returns DataFrames built from Spark's
built-in expressions, so Catalyst can push filters, prune columns and choose
join strategies. Sub-packages:

* ``functions`` - Column -> Column expressions (status, config, naming, JSON).
* ``sources``   - table DDL, writes, round trip, catalog metadata browsing.
* ``operators`` - registry mutations, access evaluation, activity, notebooks,
  SQL cells.
* ``plans``     - join strategy helpers and the registered query catalogue.
* ``streaming`` - Structured Streaming versions of the activity operators.
"""

__version__ = "0.1.0"
