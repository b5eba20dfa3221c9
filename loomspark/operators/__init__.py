"""DataFrame operators of corpus curation."""
