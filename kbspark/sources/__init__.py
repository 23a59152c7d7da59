"""Reading tables, text files and line-delimited JSON."""
