"""Query registry: which query runs which operators, and the SQL that checks it."""
