"""Training-data operators: archives, mixing, chat rendering, classifiers,
similarity joins, sharding, decontamination, language, personal data, rules.

Nothing outside this subpackage imports it.
"""
