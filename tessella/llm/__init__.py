"""Training-data operators: quality, language, search, tokens, near copies, mixing, chat. Nothing else in the library imports this."""
