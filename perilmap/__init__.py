"""Risk-factor analytics on Spark: cases, couplings, transitions, scores."""
