"""Query specifications: parsed, validated, and turned into plans."""
