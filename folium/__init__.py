"""folium: a Spark-native engine for corpora of text pages."""
