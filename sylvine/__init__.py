"""Vector search, filtered retrieval and document search as ordinary Spark plans."""
