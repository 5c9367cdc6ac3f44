"""ledgerloom: a PySpark-native analytics engine for a provenance-first public-records ledger."""

__version__ = "0.1.0"
