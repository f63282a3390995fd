"""Lodestone: semantic retrieval and corpus analytics expressed as Spark plans."""
