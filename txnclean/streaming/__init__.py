"""txnclean.streaming."""
