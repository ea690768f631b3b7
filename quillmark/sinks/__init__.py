"""Writing: whole files, lines, corpora, runs."""
