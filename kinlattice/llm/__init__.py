"""Training-data operators: tokenising, filtering and de-duplicating large text tables."""
