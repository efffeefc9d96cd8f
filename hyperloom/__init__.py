"""Higher-order closure analytics on hypergraphs, and training-data operators, as Spark plans."""
