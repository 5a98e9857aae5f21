"""Training-data operators (secrets, HTML, packing, language, near duplicates, decontamination,
toxicity, nearest neighbours, repeated text, chat rendering).  Nothing else in ``strata`` imports
this package; ``queries.py`` holds the registered queries and their SQL."""
