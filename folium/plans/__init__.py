"""A corpus of many wikis as tables in a folder, with the nine operations."""
