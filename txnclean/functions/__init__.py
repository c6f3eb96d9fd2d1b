"""txnclean.functions."""
