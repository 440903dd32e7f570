"""Training-data operators: every module here stands alone from the rest of the library."""
