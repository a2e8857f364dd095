"""corpusmill: a PySpark-native engine for text corpora, retrieval, concept graphs and answer scoring."""
