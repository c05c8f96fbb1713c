"""DataFrame-to-DataFrame operators of the risk analytics."""
