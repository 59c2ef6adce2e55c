"""Operators on documents for language-model data: encoding, packing, language labels. Nothing outside imports this."""
