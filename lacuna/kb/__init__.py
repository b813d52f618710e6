"""The knowledge base."""

from lacuna.kb.knowledge_base import KnowledgeBase

__all__ = ["KnowledgeBase"]
