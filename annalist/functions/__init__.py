from annalist.functions.text import html_text, removals, tokens

__all__ = ["html_text", "removals", "tokens"]
