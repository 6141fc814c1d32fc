"""Named queries over the standard tables, with the same results as SQL."""

from weftline.queries import conversions, relational, semantic, texts

BOOKS = (relational, texts, semantic, conversions)
QUERIES = {k: v for b in BOOKS for k, v in b.QUERIES.items()}
ORACLES = {k: v for b in BOOKS for k, v in b.ORACLES.items()}
