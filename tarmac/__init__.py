"""tarmac: daily airport-traffic analytics on Spark.

Layers:

* ``tarmac.sources``   – raw traffic reader (CSV/Parquet), fixture view, dimensions, artifacts
* ``tarmac.functions`` – Column expressions (calendar, cyclic, phase, binning, labels)
* ``tarmac.operators`` – DataFrame operators (baselines, bins, summaries, exploration, metrics)
* ``tarmac.ml``        – Spark ML pipelines, training, early stopping, batch scoring
* ``tarmac.plans``     – prepared feature table and the query catalog
"""

__version__ = "0.1.0"
