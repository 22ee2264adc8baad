"""Training-data operators: self-contained; nothing outside this folder imports them."""
