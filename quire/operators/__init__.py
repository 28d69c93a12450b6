"""DataFrame-to-DataFrame operators of the document pipeline."""
