"""From a query description to a DataFrame."""
