"""Column functions: text keys, spans, amounts, math."""
