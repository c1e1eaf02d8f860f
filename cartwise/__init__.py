"""cartwise: Spark-native bundle recommendation and basket analytics.

Every public function takes and returns a ``pyspark.sql.DataFrame`` (or a
``Column``), so steps chain with ``df.transform``.  Sub-packages:

* ``sources``   - table readers/writers and the semantic renaming layer
* ``functions`` - Column-level helpers (text, dates, arrays, scaling)
* ``operators`` - DataFrame-level operators (filters, joins, aggregates,
                  windows, rules, similarity, factorisation, graph tables)
* ``plans``     - composed pipelines (invoice build, ratings, bundles)
"""

from cartwise.config import BundleConfig  # noqa: F401

__all__ = ["BundleConfig"]
