"""Text tokenization as DataFrame operations: a declarative pipeline over columns of text."""
