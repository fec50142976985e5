"""quarry: document search and lakehouse-governance jobs on Spark.

Every operator takes DataFrames and returns a DataFrame; no operator creates
a session or collects data to the driver.  Sub-packages:

* ``functions``  – column expressions (names, keys, paths, JSON, redaction)
* ``operators``  – DataFrame jobs (index, search, lookups, reconcile, runs)
* ``sources``    – file scans and sinks
* ``plans``      – fixture derivations and the registered query catalog
* ``streaming``  – Structured Streaming variants
"""

__all__ = ["session"]
