"""Training-data operators: decontamination, secrets, sharding, near-duplicates, PII, HTML text, packing, toxicity, token
files, languages, joins kept up to date, hard negatives. Nothing else in the library imports this subpackage."""
