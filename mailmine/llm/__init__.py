"""Training-data operators: text de-duplication, decontamination, quality, secrets, tokens, URL lists."""
