"""blockloom: multi-resolution vector quantisation of frames and other fixed-width vectors on Spark."""
