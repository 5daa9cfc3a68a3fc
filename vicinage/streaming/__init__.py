"""No operator streams: all of them need the whole set of points."""
