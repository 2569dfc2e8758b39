"""Part of quillgraph."""
