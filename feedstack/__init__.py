"""feedstack: review-feed ingest, quality, dedup, ledger and analytics on Spark.

Everything is expressed as DataFrame / SQL plans so Catalyst and AQE choose the
physical strategy; there is no row-at-a-time Python anywhere in the hot path.
"""

__version__ = "0.1.0"
