"""DataFrame operators: sections, duplicates, chunks, search, routing, answers."""
