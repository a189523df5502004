"""Relational operators: spans, layout, registry, mentions, resolution, evaluation."""
