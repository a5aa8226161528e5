"""Recording rules over streams."""
