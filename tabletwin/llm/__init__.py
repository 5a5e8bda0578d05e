"""Operators of a training-data pipeline (personal data, joins, deduplication, mixing, rules, classifier,
decontamination, secrets, sharding). Self-contained: nothing outside this subpackage imports it."""
