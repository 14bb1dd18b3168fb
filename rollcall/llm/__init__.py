"""Training-data operators: packing, near-duplicate removal, quality, toxicity, tokenisation and formatting.

Nothing outside this folder imports it. ``queries`` binds each operator to the documents, embeddings and
conversations tables; the operators themselves take any DataFrame and column names.
"""
