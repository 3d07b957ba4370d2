"""Operators for large training-data collections; nothing else imports this."""
