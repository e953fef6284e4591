"""A Spark-first engine for sentence corpora, vector codes, and the training sets built from them."""
