"""Operators for preparing training text: classifiers, near duplicates, decontamination, scans, archives, tokens, chats."""
