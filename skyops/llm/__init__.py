"""Training-data operators (scoring, filtering, near duplicates, formatting, token files).

Nothing outside this package imports it; ``queries.py`` registers one query per operator.
"""
