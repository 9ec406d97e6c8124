"""Named queries, their SQL counterparts and the end-to-end pipeline."""
