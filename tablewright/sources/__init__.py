"""Reading files and archives, and writing results."""
