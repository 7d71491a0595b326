"""Tables: delimited text in, stored tables, text out."""
