"""Reading and writing: catalogs, landed pages, newline-JSON records, results."""
