"""Ready-made plans over the tables of a folder."""
