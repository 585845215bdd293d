"""Operators that prepare training text at scale; nothing else imports them."""
