"""Reading the canonical tables and corpora, and writing results."""
