"""Operators that prepare text for language models; nothing else imports this package."""
