"""Driver-side planning: query inputs, verbs, cursors and the query registry."""
