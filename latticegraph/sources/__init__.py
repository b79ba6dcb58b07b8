"""Table projections and file codecs."""
