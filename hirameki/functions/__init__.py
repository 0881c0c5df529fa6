"""Column functions: text, vocabulary, morphology, metrics and scores."""
