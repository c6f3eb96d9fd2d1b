"""txnclean.operators."""
