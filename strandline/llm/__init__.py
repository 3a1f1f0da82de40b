"""Operators for building training data: tokens, personal data, toxicity, leakage, copies, vectors, archives, pages and chats."""
