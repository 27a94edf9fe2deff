"""Training-data operators: decontamination, tokenising, dedup, scoring, privacy and secrets.

One module per operator; ``queries`` registers one query per operator and ``arrays`` / ``frames`` hold what they share.
Every operator takes DataFrames and returns DataFrames; nothing else in the package imports this one.
"""
