"""Full-text, vector and structured search over tables of documents, as Spark plans."""
