"""Training-corpus operators: archives, cleaning, duplicates, leaks, personal data, tokens.

Nothing outside this folder imports it.
"""
