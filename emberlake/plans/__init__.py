"""Named reports and composed retrieval plans."""
