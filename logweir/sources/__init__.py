"""Reading and writing tables, exports and the views derived from an event table."""
