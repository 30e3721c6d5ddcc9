"""Training-data operators: mixing, PII, language-model scoring, chat formatting, joins, search,
toxicity, BPE, quality rules and substring removal. Nothing else in the library imports this."""
