"""DataFrame operators of the traffic analysis."""
