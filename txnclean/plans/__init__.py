"""txnclean.plans."""
