"""Program-ledger analytics on Spark."""
