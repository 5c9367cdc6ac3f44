"""Functions of the public-records ledger engine."""
