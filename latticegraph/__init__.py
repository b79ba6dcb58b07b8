"""A PySpark-native engine for canonicalizing periodic crystal structures and querying the graph they form."""
