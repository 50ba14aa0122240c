"""Reading corpora, logs and configurations, and writing them."""
