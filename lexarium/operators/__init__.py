"""The operators; each takes a DataFrame of documents and gives a DataFrame."""
