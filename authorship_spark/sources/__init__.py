"""Reading files of texts, and writing results."""
