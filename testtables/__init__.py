"""The thirteen roles over the given test tables, and the SQL each registered query is checked against."""
