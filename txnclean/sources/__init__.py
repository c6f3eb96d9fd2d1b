"""txnclean.sources."""
