"""The user-facing verbs, each a composition of sources, operators and sinks."""
